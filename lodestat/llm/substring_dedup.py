"""Substring deduplication over words.

The method is that of ``repeats``, which op10 uses as well: windows of ``size`` words meet by their
anchor and are compared by fingerprint. A window is a duplicate if an equal one stands at an earlier
place of the corpus; duplicate windows that overlap or touch make one span. No greedy Lempel-Ziv
factors against reference blocks are formed.

Null or empty texts and texts of fewer than ``size`` words have no spans. A null doc_id comes before
all others. Rows that repeat a doc_id and its text are one place, so neither makes the other a
repeat; different texts under one doc_id are parsed apart. ``cleaned`` keeps other columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestat.llm.repeats import merged, repeated_spans
from lodestat.llm.text import buffer, slices, word_spans

#: Words of an anchor.
ANCHOR = 4


def _parts(batch):
    """For each text: bytes of its slice, where it begins and ends, its words' starts and ends, and factors in words."""
    data, offsets = buffer(batch.column("text"))
    for a, b in slices(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, begin = word_spans(part, at)
        for i in range(a, b):
            lo, hi = begin[i - a], begin[i - a + 1]
            yield part, at[i - a], at[i - a + 1], starts[lo:hi], ends[lo:hi], merged(batch.column("_spans")[i].as_py())


def _kept_runs(n: int, factors: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *factors.reshape(-1).tolist(), n]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]


def _digest(batches):
    for batch in batches:
        words, removed, sha = [], [], []
        for part, _, _, starts, ends, factors in _parts(batch):
            n, digest = len(starts), hashlib.sha256()
            solid = True
            for a, b in _kept_runs(n, factors):
                piece = part[starts[a]:ends[b - 1]]
                s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
                if not solid:
                    digest.update(b" ")
                if (s[1:] - e[:-1] == 1).all():
                    piece = piece.copy()
                    piece[e[:-1]] = 32
                    digest.update(piece.tobytes())
                else:
                    text = piece.tobytes()
                    digest.update(b" ".join(text[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)))
                solid = False
            words.append(n)
            removed.append(int((factors[:, 1] - factors[:, 0]).sum()))
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(batches):
    for batch in batches:
        texts = []
        for i, (part, at, stop, starts, ends, factors) in enumerate(_parts(batch)):
            if not len(factors):
                texts.append(batch.column("text")[i].as_py())
                continue
            # white space after a removed word goes with it
            text = []
            for a, b in factors.tolist():
                text.append(part[at:starts[a]].tobytes())
                at = starts[b] if b < len(starts) else ends[b - 1]
            text.append(part[at:stop].tobytes())
            texts.append(b"".join(text).decode())
        names = [c for c in batch.schema.names if c != "_spans"]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)


def factors(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` with packed spans (null: none) of words that repeat ``size`` words found earlier."""
    return repeated_spans(docs, size, min(ANCHOR, size), words=True, any_order=False)


def digests(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words kept, one row for each row of docs."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return factors(docs, size).select("doc_id", "text", "_spans").mapInArrow(
        _digest, f"doc_id {fields['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` without repeated words; white space between kept words stays."""
    return factors(docs, size).select(*docs.columns, "_spans").mapInArrow(_cut, docs.schema)
