"""Rows without doc_id are told apart by their whole text; texts with NUL keep to themselves."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash

import corpus_pipeline
from lodestat.llm import jaccard_join, language_model, pieces, substring_dedup, suffix_dedup

REPEATING = "again " * 60


def unlike_pair():
    """Two unlike texts whose hashes agree in 31 bits."""
    bits = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() & 0x7FFFFFFF
    long = {bits(t): t for t in (f"{REPEATING}{i}" for i in range(120_000))}
    return next((long[b], t) for t in (f"one{i}" for i in range(300_000)) if (b := bits(t)) in long)


def test_unlike_rows_without_doc_id(spark):
    long, short = unlike_pair()
    docs = spark.createDataFrame([(None, long), (None, short), (1, "x y z")], "doc_id long, text string")
    n = len(long.split())
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.digests(docs).collect()) == [(1, 0), (3, 0), (n, 59)]
    assert {(r.n_bytes, r.n_removed > 0) for r in suffix_dedup.digests(docs).collect()} == {(len(long), False), (len(short), False), (5, False)}
    assert sorted(r.n_tokens for r in language_model.scores(docs).collect()) == [2, 4, n + 1]
    rows, _ = jaccard_join.jaccard_join(docs, k=4, percent=85)
    assert sorted(r.n_shingles for r in rows.collect()) == [1, 1, 2]
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 3


def test_pieces_of_texts_with_nul(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = ["hello there", "x\0", "\0", "a\0b \0\0 c", "plain words", "\0" * 60 + "end"] + [
        "".join(rng.choice("ab \0é") for _ in range(rng.randrange(30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: list(r.ids) for r in pieces.encode(docs, path).collect()}
    assert got == {i: model.encode(t) for i, t in enumerate(texts)}


def test_order_of_suffixes():
    """As by whole comparison: equal heads, equal suffixes, high bytes, and suffixes shorter than a head."""
    rng = np.random.default_rng(4)
    for width, letters in ((4, b"ab"), (8, b"ab"), (20, b"a"), (20, b"ab\xff"), (48, bytes(range(1, 256)))):
        data = np.frombuffer(bytes(rng.choice(list(letters), 3000).tolist()) + b"\xff" * width, np.uint8)
        suffix = np.lib.stride_tricks.sliding_window_view(data, width).copy().view(f"S{width}").ravel()
        assert (pieces._in_order(suffix) == np.argsort(suffix, kind="stable")).all()


def test_pieces_in_order_of_size():
    """Edges with one end come in the order of their pieces, the longest first."""
    sizes = pieces.Matcher(public_tokenizers.path("piece_bpe_32k.model")).sizes
    assert (np.diff(sizes) <= 0).all()


def test_pairs_that_share_a_slot(monkeypatch):
    """Whether pieces stay neighbours doesn't depend on which pairs were looked at last."""
    monkeypatch.setattr(pieces, "CACHE", 3)
    matcher = pieces.Matcher(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(6)
    some = rng.choice(matcher.numbers, 40)
    for _ in range(4):
        a, b = rng.choice(some, 300), rng.choice(some, 300)
        assert matcher._all_stay(a, b).tolist() == [matcher._stays(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
