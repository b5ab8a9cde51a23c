"""Token counts and byte-level BPE against the plain encoder."""

import pytest

from marlstone.llm import bpe, token_counts, vocabulary

from .helpers import AWKWARD, SCHEMA, frame, key, sentence


def test_whole_tokens_are_proven():
    whole = vocabulary.prove_whole()
    ranks = vocabulary.ranks()
    assert " the" in whole and "hello world" not in whole
    for s in list(whole)[::500]:
        assert vocabulary.splitter().findall(s) == [s]
        assert vocabulary.encoding().encode_ordinary(s) == [ranks[s.encode()]]


def test_counts_match_encoder(spark):
    encode = vocabulary.encoding().encode_ordinary
    got = token_counts.count_tokens(frame(spark, AWKWARD)).collect()
    want = [(k, None, None, None) if t is None else (k, len(p := vocabulary.splitter().findall(t)), sum(x in vocabulary.prove_whole() for x in p), len(encode(t))) for k, t in AWKWARD]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 11), (50, 20), (7, 3)])
def test_encoding_is_that_of_the_plain_encoder(spark, chunk, overlap):
    docs = [(k, t if t is None or chunk > 1000 else t[:3000]) for k, t in AWKWARD]
    docs += [(20, "it's we'll   many    spaces\n\n  x 12345 abc!!! " * 5), (20, "it's we'll   many    spaces\n\n  x 12345 abc!!! " * 5), (21, sentence(9, 30))]
    encode = vocabulary.encoding().encode_ordinary
    got = bpe.encode(frame(spark, docs), chunk=chunk, overlap=overlap).collect()
    want = [(k, None, None) if t is None else (k, (e := encode(t)), len(e)) for k, t in docs]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("gap", ["\n\n", "\t\t", " \n\n", "\n", "   "])
def test_white_space_right_before_a_border(spark, gap):
    docs = [(i, (sentence(i, 40)[: 64 - len(gap) - i] + gap + sentence(70 + i, 40) + gap) * 2) for i in range(3)]
    encode = vocabulary.encoding().encode_ordinary
    got = {r[0]: r[1] for r in bpe.encode(frame(spark, docs), chunk=64, overlap=32).collect()}
    assert got == {k: encode(t) for k, t in docs}


def test_random_texts_of_white_space_and_words(spark):
    """Hundreds of texts whose chunks begin anywhere, by chunk sizes from tiny to large."""
    import random

    r = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "word", "it's", "'ll", "12", "3.5", "...", "é", "東京", "😀", "a", "x" * 9, "\r\n", "'", "I'D"]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 400)))) for i in range(400)]
    encode = vocabulary.encoding().encode_ordinary
    want = {k: encode(t) for k, t in docs}
    for chunk, overlap in ((64, 32), (17, 16), (200, 40)):
        assert {x[0]: x[1] for x in bpe.encode(frame(spark, docs), chunk=chunk, overlap=overlap).collect()} == want


def test_ids_of_the_documents_are_those_of_the_plain_encoder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encode = vocabulary.encoding().encode_ordinary
    want = {r.doc_id: encode(r.text) for r in docs.collect()}
    assert {r[0]: r[1] for r in bpe.encode(docs, chunk=1500, overlap=300).collect()} == want
    assert {r[0]: r[1] for r in bpe.encode(docs).collect()} == want


def test_both_splitters_know_the_same_classes():
    """Characters for which Python's splitter and the encoder's would cut differently: only ones that one of them doesn't know yet."""
    import unicodedata

    encode, merge = vocabulary.encoding().encode_ordinary, vocabulary.encoding()._core_bpe.encode_single_piece
    odd = []
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        text = f"a{chr(c)}b  {chr(c)}"
        if encode(text) != [i for p in vocabulary.splitter().findall(text) for i in merge(p.encode())]:
            odd.append(chr(c))
    assert all(unicodedata.category(c) == "Cn" or unicodedata.unidata_version < "16" for c in odd), odd[:20]


def test_long_pieces_are_not_remembered(spark):
    docs = [(i, "y" * (100 + i) + " word") for i in range(20)]
    encode = vocabulary.encoding().encode_ordinary
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, docs)).collect()} == {k: len(encode(t)) for k, t in docs}
    lengths = token_counts._Lengths([], vocabulary.RANKS_PATH)
    assert lengths["y" * 5000] == len(encode("y" * 5000)) and lengths["short"] and list(lengths) == ["short"]


def test_long_runs_that_never_resynchronise(spark):
    docs = [(1, "y" * 500), (2, "q" * 40 + " " + "r" * 300), (3, " " * 400 + "z")]
    encode = vocabulary.encoding().encode_ordinary
    got = {r[0]: r[1] for r in bpe.encode(frame(spark, docs), chunk=64, overlap=16).collect()}
    assert got == {k: encode(t) for k, t in docs}


def test_round_trip(spark):
    docs = frame(spark, AWKWARD)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(map(tuple, back), key=key) == sorted(AWKWARD, key=key)
    full = bpe.checked(bpe.encode(docs)).collect()
    assert sorted([(r.doc_id, r.decoded_chars) for r in full], key=key) == sorted([(k, None if t is None else len(t)) for k, t in AWKWARD], key=key)


def test_bytes_are_concatenated():
    text = "naïve 東京 😀 it's"
    assert bpe.decode_ids(bpe.encode_text(text)).decode() == text
    assert bpe.decode_ids(bpe.encode_text("")) == b""


def test_encoding_an_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0
