"""Byte-level BPE vocabularies, read from a rank file whose path is a parameter.

The file must be readable under the same path on every node.  It is never
copied: each Python worker loads it once.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
import tiktoken

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str = RANKS_PATH) -> tiktoken.Encoding:
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(maxsize=4)
def token_bytes(path: str = RANKS_PATH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, each id's start in it, and its length."""
    by_id = ranks(path)
    size = max(by_id.values()) + 1
    parts = [b""] * size
    for token, rank in by_id.items():
        parts[rank] = token
    length = np.fromiter(map(len, parts), dtype=np.int64, count=size)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(length) - length, length


@lru_cache(maxsize=4)
def prove_whole(path: str = RANKS_PATH) -> frozenset[str]:
    """The vocabulary strings that, alone, are one pre-token and merge into exactly one token.

    For each, the splitter must take the string as a single pre-token and the
    merges must end with its own id; bytes that aren't UTF-8 never qualify, as
    no text has them by themselves.
    """
    encode, match, found = encoding(path).encode_ordinary, splitter().fullmatch, []
    for token, rank in ranks(path).items():
        try:
            string = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if match(string) and splitter().findall(string) == [string] and encode(string) == [rank]:
            found.append(string)
    return frozenset(found)
