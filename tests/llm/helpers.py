"""Documents that are hard to handle, and plain versions of the splitting rules."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, tag int, row int, line string, d int, h int, u int, lines int, text_1 string, `a b.c` string, bucket string, word string, once string"


def sentence(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows(pairs):
    """Rows of SCHEMA for (doc_id, text): other columns are null for half of them."""
    out = []
    for i, (k, t) in enumerate(pairs):
        rest = ("en", "s", None if t is None else len(t)) if i % 2 else (None, None, None)
        out.append((k, t, *rest, *([None] * 13 if i % 3 else ["x", 1, 2, "y", 3, 4, 5, 6, "z", "q", "b", "w", "o"])))
    return out


def frame(spark, pairs):
    return spark.createDataFrame(rows(pairs), SCHEMA)


A, B = sentence(1, 120), sentence(2, 90)
AWKWARD = [
    (None, sentence(3, 70)), (None, None), (1, None), (2, ""), (3, " \n\t \n"), (4, "word"), (5, "two words"), (6, "x" * 150_000), (7, A), (7, A), (7, B), (8, A), (9, A + " tail words here"),
    (10, "Ünïcode Straße 東京   emoji 😀 " * 3), (11, "same same same same " * 60), (12, "\n".join(["line one is here", "line one is here", "", "other line"])), (13, sentence(4, 40_000, 5000)), (-5, "negative id"), (14, "a\u0000b nul"), (15, "ends with newline\n"),
]


def raw_words(text):
    return re.findall(rb"[^\x00-\x20]+", (text or "").encode())


def folded_words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def key(row):
    return tuple((x is not None, x) if not isinstance(x, list) else (True, tuple(x)) for x in row)
