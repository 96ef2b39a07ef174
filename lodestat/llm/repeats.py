"""Repeated windows of a fixed length, found over texts of any number and shared by two operators.

Every window contains an anchor: its smallest k-gram fingerprint. The windows of one text that share
an anchor form a run; the run and the text it covers make one record. Equal windows have equal
anchors, so records meet by anchor, one record for each different run and slice of the input. Runs
that are equal throughout are settled there. Runs that share the anchor only are compared window by
window in a second step, which reads only the texts that hold such runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.text import (
    BYTE_VALUES,
    Fingerprints,
    buffer,
    by_bucket,
    group_starts,
    mix,
    pack_by,
    slices,
    unpack,
    word_values,
)
from lodestat.sources.files import stored

RUN = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<u4"), ("more", "<u2"), ("lead", "<u2"), ("state", "u1")])
OPEN = np.dtype([("key", "<u8"), ("start", "<u4"), ("more", "<u2")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<u4")])
PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<u4"), ("more", "<u2")])
ONCE, TWICE, SETTLED = 0, 1, 2


def sequences(column: pa.Array, a: int, b: int, data, offsets, words: bool):
    """Fingerprints of the items (words or bytes) of texts a to b, and where each text begins."""
    part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
    if not words:
        return Fingerprints(BYTE_VALUES[part]), at
    values, _, _, begin = word_values(part, at)
    return Fingerprints(values), begin


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours."""
    n = len(x) - w + 1
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size:w - size + n]) if w > size else x[:n]


def runs(prints: Fingerprints, begin: np.ndarray, size: int, k: int):
    """Text, first window, number of further windows, anchor offset, anchor and whole fingerprint of runs."""
    n = len(prints.sums) - 1
    if n < size:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    grams = prints.grams(k)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    smallest = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), size - k + 1)
    anchor = (smallest & low).astype(np.int64)
    lengths = np.diff(begin)
    valid = np.zeros(n - size + 2, np.int32)
    long = lengths >= size
    np.add.at(valid, begin[:-1][long], 1)
    np.add.at(valid, begin[1:][long] - size + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    cut = np.ones(len(valid), bool)
    cut[1:] = ~valid[:-1] | (anchor[1:] != anchor[:-1])
    starts = np.flatnonzero(valid & cut)
    stop = np.ones(len(valid), bool)
    stop[:-1] = ~valid[1:] | cut[1:]
    ends = np.flatnonzero(valid & stop)
    lead = anchor[starts] - starts
    key = grams[anchor[starts]]
    ctx = mix(prints.of(starts, ends + size) ^ mix(lead.astype(np.uint64) + np.uint64(7)))
    return np.searchsorted(begin, starts, side="right") - 1, starts, ends - starts, lead, key, ctx


def _first_pass(size: int, k: int, words: bool, buckets: int, any_order: bool):
    def build(batches):
        for batch in batches:
            order = np.argsort(batch.column("_doc").to_numpy(zero_copy_only=False), kind="stable")
            batch = batch.take(pa.array(order))
            data, offsets = buffer(batch.column("text"))
            doc_ids = batch.column("_doc").to_numpy(zero_copy_only=False)
            row_ids = batch.column("_row").to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                prints, begin = sequences(batch.column("text"), a, b, data, offsets, words)
                d, start, more, lead, key, ctx = runs(prints, begin, size, k)
                if not len(d):
                    continue
                order = np.argsort(key ^ mix(ctx), kind="stable")  # texts are in order of doc, so the first is the earliest
                rec = np.zeros(len(d), RUN)
                rec["key"], rec["ctx"], rec["doc"], rec["row"] = key, ctx, doc_ids[a:b][d], row_ids[a:b][d]
                rec["start"], rec["more"], rec["lead"] = start - begin[d], more, lead
                rec = rec[order]
                at = group_starts(rec["key"], rec["ctx"])
                first = np.repeat(at, np.diff(np.append(at, len(rec))))
                later = (rec["doc"] > rec["doc"][first]) | (rec["start"] > rec["start"][first])
                again = np.arange(len(rec)) != first
                if any_order:
                    rec["state"][again] = SETTLED
                    rec["state"][first[again]] = TWICE
                else:  # a row that repeats the same doc and place isn't later than itself
                    rec["state"][again & later] = SETTLED
                where = np.where(rec["state"] == SETTLED, mix(rec["doc"].astype(np.uint64)), mix(rec["key"])) % np.uint64(buckets)
                out = list(by_bucket(where.astype(np.int32), rec))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "data"])
    return build


def _verdicts(spans_rec, open_rec):
    """Rows (doc, row, spans, open) of settled spans and of runs left to compare."""
    for rec, packed in ((spans_rec, "spans"), (open_rec, "open")):
        if not len(rec[0]):
            continue
        doc, row, blobs = pack_by(*rec)
        none = pa.nulls(len(doc), pa.binary())
        blobs = pa.array(blobs, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), *((blobs, none) if packed == "spans" else (none, blobs))],
                                         ["_doc", "_row", "spans", "open"])


def _meet(size: int, any_order: bool):
    def build(batches):
        parts = [unpack(b.column("data"), RUN) for b in batches]
        rec = np.concatenate(parts) if parts else np.zeros(0, RUN)
        done = rec["state"] == SETTLED
        settled, rec = rec[done], rec[~done]
        rec = rec[np.lexsort((rec["start"], rec["doc"], rec["ctx"], rec["key"]))]
        at = group_starts(rec["key"], rec["ctx"])
        sizes = np.diff(np.append(at, len(rec)))
        first = np.repeat(at, sizes)
        key_at = group_starts(rec["key"])
        contexts = np.diff(np.append(np.searchsorted(at, key_at), len(at)))
        shared = np.repeat(contexts > 1, np.diff(np.append(key_at, len(rec))))
        head = np.arange(len(rec)) == first
        if any_order:
            total = np.add.reduceat(1 + rec["state"].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            gone = np.repeat(total > 1, sizes)
        else:
            gone = ~head & ((rec["doc"] > rec["doc"][first]) | (rec["start"] > rec["start"][first]))
        left = rec[head & shared]
        settled = np.concatenate([settled, rec[gone]])
        spans = np.zeros(len(settled), SPAN)
        spans["start"], spans["end"] = settled["start"], settled["start"] + settled["more"].astype(np.uint32) + np.uint32(size)
        runs_left = np.zeros(len(left), OPEN)
        for f in ("key", "start", "more"):
            runs_left[f] = left[f]
        yield from _verdicts((settled["doc"], settled["row"], spans), (left["doc"], left["row"], runs_left))
    return build


def _starts(todo: np.ndarray) -> np.ndarray:
    """Every window of runs."""
    n = todo["more"].astype(np.int64) + 1
    return np.repeat(todo["start"].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _second_pass(size: int, words: bool, buckets: int):
    """Runs of words are sent as fingerprints of their windows, runs of bytes as the bytes they cover."""
    def build(batches):
        for batch in batches:
            data, offsets = buffer(batch.column("text"))
            for a, b in slices(offsets):
                todo = [np.frombuffer(b"".join(x), OPEN) for x in batch.column("open")[a:b].to_pylist()]
                of = np.repeat(np.arange(a, b), [len(x) for x in todo])
                todo = np.concatenate(todo)
                where = (mix(todo["key"]) % np.uint64(buckets)).astype(np.int32)
                doc = batch.column("_doc").to_numpy(zero_copy_only=False)[of]
                row = batch.column("_row").to_numpy(zero_copy_only=False)[of]
                if words:
                    prints, begin = sequences(batch.column("text"), a, b, data, offsets, words)
                    n = todo["more"].astype(np.int64) + 1
                    rec = np.zeros(n.sum(), WINDOW)
                    rec["start"] = start = _starts(todo)
                    at = start + np.repeat(begin[of - a], n)
                    rec["hash"] = prints.of(at, at + size) ^ mix(np.repeat(todo["key"], n))
                    rec["doc"], rec["row"] = np.repeat(doc, n), np.repeat(row, n)
                    out = [(k, x, b"") for k, x in by_bucket(np.repeat(where, n), rec)]
                else:
                    rec = np.zeros(len(todo), PIECE)
                    rec["doc"], rec["row"] = doc, row
                    for f in ("key", "start", "more"):
                        rec[f] = todo[f]
                    order = np.argsort(where, kind="stable")
                    rec, where, of = rec[order], where[order], of[order]
                    at = group_starts(where)
                    out = []
                    for i, j in zip(at, np.append(at[1:], len(rec)), strict=True):
                        lo = offsets[of[i:j]] + rec["start"][i:j]
                        hi = lo + rec["more"][i:j] + size
                        out.append((int(where[i]), rec[i:j].tobytes(), b"".join(data[x:y].tobytes() for x, y in zip(lo, hi, strict=True))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2))],
                                                 ["bucket", "data", "texts"])
    return build


def _windows(batches, size: int, words: bool) -> np.ndarray:
    """The windows that meet in a task, by fingerprint."""
    parts = [np.zeros(0, WINDOW)]
    for batch in batches:
        if words:
            parts.append(unpack(batch.column("data"), WINDOW))
            continue
        for packed, text in zip(batch.column("data").to_pylist(), batch.column("texts").to_pylist(), strict=True):
            todo = np.frombuffer(packed, PIECE)
            n = todo["more"].astype(np.int64) + 1
            begin = np.cumsum(n + size - 1) - (n + size - 1)
            at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rec = np.zeros(len(at), WINDOW)
            rec["hash"] = Fingerprints(BYTE_VALUES[np.frombuffer(text, np.uint8)]).of(at, at + size) ^ mix(np.repeat(todo["key"], n))
            rec["start"] = _starts(todo)
            rec["doc"], rec["row"] = np.repeat(todo["doc"], n), np.repeat(todo["row"], n)
            parts.append(rec)
    return np.concatenate(parts)


def _compare(size: int, words: bool, any_order: bool):
    def build(batches):
        rec = _windows(batches, size, words)
        rec = rec[np.argsort(rec["hash"], kind="stable") if any_order else np.lexsort((rec["start"], rec["doc"], rec["hash"]))]
        at = group_starts(rec["hash"])
        sizes = np.diff(np.append(at, len(rec)))
        first = np.repeat(at, sizes)
        if any_order:
            gone = np.repeat(sizes > 1, sizes)
        else:
            gone = (rec["doc"] > rec["doc"][first]) | (rec["start"] > rec["start"][first])
        rec = rec[gone]
        rec = rec[np.lexsort((rec["start"], rec["row"], rec["doc"]))]
        if len(rec):  # neighbouring windows become one span
            cut = np.ones(len(rec), bool)
            cut[1:] = (rec["doc"][1:] != rec["doc"][:-1]) | (rec["row"][1:] != rec["row"][:-1]) | (rec["start"][1:] > rec["start"][:-1] + 1)
            a = np.flatnonzero(cut)
            b = np.append(a[1:], len(rec)) - 1
            spans = np.zeros(len(a), SPAN)
            spans["start"], spans["end"] = rec["start"][a], rec["start"][b] + np.uint32(size)
            yield from _verdicts((rec["doc"][a], rec["row"][a], spans), (np.zeros(0), np.zeros(0), spans))
    return build


def merged(blobs: list[bytes] | None) -> np.ndarray:
    """Disjoint ascending spans from packed ones."""
    spans = np.frombuffer(b"".join(blobs or []), SPAN)
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans["start"], kind="stable")]
    start, end = spans["start"].astype(np.int64), np.maximum.accumulate(spans["end"].astype(np.int64))
    cut = np.append(True, start[1:] > end[:-1])
    at = np.flatnonzero(cut)
    return np.stack([start[at], end[np.append(at[1:], len(start)) - 1]], axis=1)


def row_keys() -> dict[str, Column]:
    """Two keys of a row: its doc_id, null before all others, and 64 bits of whether there is one and of the text.

    Rows that share both have the same text and get the same result.
    """
    return {"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_row": F.xxhash64(F.col("doc_id").isNull(), "text")}


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and the keys of a row."""
    return docs.select("doc_id", "text", *(c.alias(name) for name, c in row_keys().items()))


def _found(keyed: DataFrame, size: int, k: int, words: bool, any_order: bool) -> DataFrame:
    """_doc, _row and the packed spans of repeated windows of one size."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept, buckets = "_doc long, _row long, spans binary, open binary", 4 * parts
    first = (keyed.select("_doc", "_row", "text").mapInArrow(_first_pass(size, k, words, buckets, any_order), "bucket int, data binary")
             .repartition(parts, "bucket").select("data").mapInArrow(_meet(size, any_order), kept))
    first = stored(first)
    left = first.where("open is not null").groupBy("_doc", "_row").agg(F.collect_list("open").alias("open"))
    # with doc_id the shuffled texts are those that spans are joined to, so Spark shuffles them once
    second = (keyed.join(left, ["_doc", "_row"])
              .mapInArrow(_second_pass(size, words, buckets), "bucket int, data binary, texts binary")
              .repartition(parts, "bucket").select("data", "texts").mapInArrow(_compare(size, words, any_order), kept))
    return (first.where("spans is not null").select("_doc", "_row", "spans")
            .union(second.where("spans is not null").select("_doc", "_row", "spans"))
            .groupBy("_doc", "_row").agg(F.collect_list("spans").alias("_spans")))


def repeated_spans(docs: DataFrame, size: int, k: int, words: bool, any_order: bool, shorter: int | None = None) -> DataFrame:
    """``docs`` with ``_spans``, the packed spans of repeated windows, or null.

    ``any_order``: a window counts if it occurs twice anywhere; otherwise only its later occurrences
    do, in order of doc_id and place. With ``shorter``, ``_shorter`` are the spans of windows of that size.
    """
    keyed = with_keys(docs)
    out = docs.drop("_doc", "_row", "_spans", "_shorter").withColumns(row_keys()).join(_found(keyed, size, k, words, any_order), ["_doc", "_row"], "left")
    if shorter is None:
        return out
    return out.join(_found(keyed, shorter, min(k, shorter), words, any_order).withColumnRenamed("_spans", "_shorter"), ["_doc", "_row"], "left")
