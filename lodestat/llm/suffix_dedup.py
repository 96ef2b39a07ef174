"""Deduplication of repeated strings over bytes.

The method is that of ``repeats``, which op7 uses as well: every string of ``size`` bytes meets equal
ones by its anchor, and strings are compared by fingerprint; those with two places are repeats. No
suffix array is formed, neither of a dictionary nor of a parse, as only equality is asked for.

Null or empty texts and those shorter than ``size`` bytes have no spans. Rows that repeat a doc_id
and its text are two places, so both are removed. Strings never cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestat.llm.repeats import merged, repeated_spans
from lodestat.llm.text import buffer

#: Bytes of the rolling fingerprint.
TRIGGER = 32


def _digest(batches):
    for batch in batches:
        data, offsets = buffer(batch.column("text"))
        size, removed, spans_n, sha = [], [], [], []
        for i in range(len(batch)):
            text = data[offsets[i]:offsets[i + 1]]
            spans = merged(batch.column("_spans")[i].as_py())
            digest, at = hashlib.sha256(), 0
            for a, b in spans.tolist():
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            size.append(len(text))
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            spans_n.append(len(spans))
            sha.append(digest.hexdigest())
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans_n)), pa.array(sha, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if "_shorter" in batch.schema.names:
            found = [np.diff(merged(x), axis=1) for x in batch.column("_shorter").to_pylist()]
            columns += [pa.array([int(x.sum()) for x in found], pa.int64()), pa.array([int(x.max(initial=0)) for x in found], pa.int64())]
            names += ["n_repeated", "longest_repeated"]
        yield pa.RecordBatch.from_arrays(columns, names)


def spans(docs: DataFrame, size: int = 400, shorter: int | None = None) -> DataFrame:
    """doc_id, text and packed byte spans (null: none) covered by strings of ``size`` bytes with two places; in ``_shorter`` of that size."""
    return repeated_spans(docs, size, min(TRIGGER, size), words=False, any_order=True, shorter=shorter)


def digests(docs: DataFrame, size: int = 400, shorter: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept, one row for each row of docs.

    With ``shorter``: n_repeated, the bytes covered by strings of that size with two places, none of
    which are removed for it, and longest_repeated, their longest run.
    """
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    columns = ["_spans"] if shorter is None else ["_spans", "_shorter"]
    more = "" if shorter is None else ", n_repeated long, longest_repeated long"
    return spans(docs, size, shorter).select("doc_id", "text", *columns).mapInArrow(
        _digest, f"doc_id {fields['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
