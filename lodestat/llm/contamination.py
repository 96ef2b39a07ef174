"""Benchmark passages in a corpus, found with a positional inverted index.

``index`` stores, for every block of documents and every word in it, the positions of the word: one row
for each (block, word), so that a frequent word has many bounded lists. ``search`` orders the words of
each query window by their number in the whole corpus, rarest first, and takes the window up in those
blocks only whose index has the rarest one. Inside a block the list of the rarest word, moved by the
word's offset in the window, is intersected with the moved lists of the others in turn; what stays are
exact phrases. With ``slop`` above 0 the lists are intersected within that distance: proximity matches.

Words are maximal runs of ASCII letters and digits and of any other non-ASCII characters, A-Z in lower
case, and are held by 64-bit fingerprints. Results for special input: null or empty texts have no words
and match nothing; an item shorter than the window is one window; an item without words has none; items
are told apart by item_id, null counting as the empty id; rows that repeat a doc_id are rows of their
own; empty tables give no rows or no matches; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.text import MARKS, buffer, group_starts, slices, word_values
from lodestat.sources.files import stored

#: One entry for each document of a block, in the row without a word.
ENTRY = np.dtype([("doc", "<i8"), ("known", "u1"), ("words", "<i8")])
POSITION = np.dtype("<u4")
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.string()), ("exact", pa.bool_())])
FOUND = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                   ("classes", pa.list_(pa.string())), ("spans", pa.list_(SPAN))])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Between two documents one position stays free, so no phrase goes across."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = buffer(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64())
        for a, b in slices(offsets):
            words, _, _, begin = word_values(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], True, MARKS)
            entry = np.zeros(b - a, ENTRY)
            part = ids.slice(a, b - a)
            entry["doc"] = part.fill_null(0).to_numpy(zero_copy_only=False)
            entry["known"] = part.is_valid().to_numpy(zero_copy_only=False)
            entry["words"] = counts = np.diff(begin)
            at = np.arange(len(words)) + np.repeat(np.arange(b - a), counts)
            order = np.argsort(words, kind="stable")
            words, at = words[order], at[order].astype(POSITION)
            starts = group_starts(words)
            ends = np.append(starts, len(words))
            lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(at)])
            schema = ["block", "term", "n", "data"]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.array([b - a]), pa.array([entry.tobytes()], pa.binary())], schema)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), block)), pa.array(words[starts].view(np.int64)), pa.array(np.diff(ends)), lists], schema)
            block += 1


def index(docs: DataFrame) -> DataFrame:
    """Stored postings (block, term, n, data); a row without a term lists the documents of its block."""
    return stored(docs.select("doc_id", "text").mapInArrow(_postings, "block long, term long, n long, data binary"))


def _windows(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column("text"))
            items = batch.column("item")
            for a, b in slices(offsets):
                words, _, _, begin = word_values(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], True, MARKS)
                words = words.view(np.int64)
                for i, (lo, hi) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                    width = min(size, hi - lo)
                    if not width:
                        continue
                    rows = np.unique(np.lib.stride_tricks.sliding_window_view(words[lo:hi], width), axis=0)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([items[a + i].as_py()] * len(rows), pa.string()), lists], ["item", "terms"])
    return build


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Each different window once: terms, items that have it, and class, the same for the same items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return (items.mapInArrow(_windows(size), "item string, terms array<long>").groupBy("terms")
            .agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("class", F.md5(F.to_json(F.struct("items")))))


def _search(slop: int):
    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        terms = left.column("term").combine_chunks()
        listed = terms.is_valid().to_numpy(zero_copy_only=False)
        blobs = left.column("data").to_pylist()
        entry = np.frombuffer(b"".join(x for x, t in zip(blobs, listed, strict=True) if not t), ENTRY)
        block = left.column("block")[0].as_py()
        begin = np.cumsum(entry["words"] + 1) - (entry["words"] + 1)
        n = len(entry)
        hits = [([], []) for _ in range(n)]  # classes and spans of each document
        covered = np.zeros(n, np.int64)
        if right.num_rows:
            own = terms.drop_null().to_numpy()
            lists = [x for x, t in zip(blobs, listed, strict=True) if t]
            order = np.argsort(own, kind="stable")
            own, lists = own[order], [lists[i] for i in order]
            sizes = np.array([len(x) // 4 for x in lists], np.int64)
            heads = np.cumsum(sizes) - sizes
            places = np.frombuffer(b"".join(lists), POSITION).astype(np.int64)
            keys = (np.repeat(np.arange(len(own)), sizes) << 32) | places  # all lists in one sorted array
            probes = right.column("probes").combine_chunks()
            bounds = probes.offsets.to_numpy().astype(np.int64)
            flat = probes.flatten()
            offs, want = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("off", "term"))
            rank = np.minimum(np.searchsorted(own, want), max(0, len(own) - 1))
            known = own[rank] == want if len(own) else np.zeros(len(want), bool)
            width = np.diff(bounds)
            bounds = bounds - bounds[0]
            rank[~known] = -1
            whole = np.minimum.reduceat(rank, bounds[:-1]) >= 0
            window = np.flatnonzero(whole)  # windows whose words all occur in the block
            first = rank[bounds[window]]
            at = np.repeat(heads[first] - (np.cumsum(sizes[first]) - sizes[first]), sizes[first]) + np.arange(sizes[first].sum())
            window = np.repeat(window, sizes[first])
            start = places[at] - offs[bounds[window]]
            last = begin + entry["words"]
            doc = np.searchsorted(begin, places[at], side="right") - 1
            low, high = start.copy(), start + width[window]
            exact = np.ones(len(start), bool)
            keep = (start >= begin[doc] - slop) & (start + width[window] <= last[doc] + slop)
            for k in range(1, int(width.max(initial=1))):
                window, start, doc, low, high, exact = (x[keep] for x in (window, start, doc, low, high, exact))
                keep = np.ones(len(window), bool)
                more = np.flatnonzero(k < width[window])
                if not len(more):
                    continue
                probe = bounds[window[more]] + k
                base, target = rank[probe] << 32, start[more] + offs[probe]
                i = np.searchsorted(keys, base | np.maximum(target, 0))  # the nearest place, after or before
                after, before = keys[np.minimum(i, len(keys) - 1)] - base, keys[np.maximum(i - 1, 0)] - base
                near = np.where(np.abs(after - target) <= np.abs(before - target), after, before)
                inside = (np.abs(near - target) <= slop) & (near >= begin[doc[more]]) & (near < last[doc[more]])
                keep[more] = inside
                exact[more] &= near == target
                low[more], high[more] = np.minimum(low[more], near), np.maximum(high[more], near + 1)
            window, start, doc, low, high, exact = (x[keep] for x in (window, start, doc, low, high, exact))
            low = np.where(exact, start, np.maximum(low, begin[doc])) - begin[doc]
            high = np.where(exact, start + width[window], np.minimum(high, last[doc])) - begin[doc]
            classes = right.column("class").to_pylist()
            codes, code = np.unique(np.array(classes, dtype=object), return_inverse=True)
            code = code[window]
            order = np.lexsort((high, low, ~exact, code, doc))
            doc, code, low, high, exact = (x[order] for x in (doc, code, low, high, exact))
            if len(doc):  # touching matches of one class become one span
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]) | (exact[1:] != exact[:-1])
                run = np.cumsum(new) << 33
                reach = np.maximum.accumulate(run + high) - run
                new[1:] |= low[1:] > reach[:-1]
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(doc)) - 1
                for d, c, x, y, z in zip(doc[s].tolist(), code[s].tolist(), low[s].tolist(), reach[e].tolist(), exact[s].tolist(), strict=True):
                    if not hits[d][0] or hits[d][0][-1] != codes[c]:
                        hits[d][0].append(codes[c])
                    hits[d][1].append({"start": x, "end": y, "class": codes[c], "exact": z})
                for d in np.unique(doc).tolist():
                    end = 0
                    for x, y in sorted((s["start"], s["end"]) for s in hits[d][1]):
                        covered[d] += max(0, y - max(x, end))
                        end = max(end, y)
        ids = pa.array(entry["doc"], mask=entry["known"] == 0)
        return pa.Table.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n)), ids, pa.array(entry["words"]), pa.array(covered),
                                     pa.array([h[0] for h in hits], FOUND.field("classes").type), pa.array([h[1] for h in hits], FOUND.field("spans").type)],
                                    schema=FOUND)
    return build


def search(postings: DataFrame, queries: DataFrame, slop: int = 0) -> DataFrame:
    """block, place, doc_id, n_words, n_hit, classes and spans of every document of the index.

    ``queries`` are windows (terms, class), stored. A span (start, end, class, exact) is a run of words
    that matches of one class cover; n_hit counts words in any span. With ``slop`` a word of a window may
    lie up to that many places off its own, measured from the window's rarest word, and the nearest
    occurrence is taken; ``exact`` is false if any does.
    """
    words = queries.select("terms", "class", F.posexplode("terms").alias("off", "term"))
    asked = stored(words.select("term").distinct())
    lists = postings.join(asked, "term", "left_semi")
    counts = stored(lists.groupBy("term").agg(F.sum("n").alias("_n")))
    plans = (words.join(counts, "term", "left").groupBy("terms", "class")
             .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "off", "term"))).alias("probes"))
             .where(F.col("probes")[0]["_n"] > 0)
             .select("class", F.col("probes")[0]["term"].alias("term"), F.transform("probes", lambda x: F.struct(x["off"].alias("off"), x["term"].alias("term"))).alias("probes")))
    pairs = postings.select("block", "term").join(stored(plans), "term").select(F.col("block").alias("at_block"), "probes", "class")
    needed = lists.select("block", "term", "data").union(postings.where("term is null").select("block", "term", "data"))
    return needed.groupBy("block").cogroup(pairs.groupBy("at_block")).applyInArrow(
        _search(slop), "block long, place long, doc_id long, n_words long, n_hit long, classes array<string>, "
                       "spans array<struct<start:long,end:long,class:string,exact:boolean>>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (item ids as sorted text) and spans of the matches."""
    queries = stored(windows(benchmark, size))
    found = stored(search(index(docs), queries.select("terms", "class"), slop))
    classes = stored(queries.select("class", "items").dropDuplicates(["class"]))
    items = (found.select("block", "place", F.explode("classes").alias("class")).join(classes, "class")
             .select("block", "place", F.explode("items").alias("item")).groupBy("block", "place").agg(F.sort_array(F.collect_set("item")).alias("items")))
    return found.join(items, ["block", "place"], "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
