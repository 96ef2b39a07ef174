"""Language-model scores from Elias-Fano n-gram tries, cut into shards by the word before.

The model predicts a word from the ``order`` - 1 words before, the text being preceded by as many starts:
p(word | context) = (c(context, word) + MASS * p(word | context without its earliest word)) / (c(context) + MASS),
down to base = (c(word) + 0.5) / (N + 0.5 * (V + 1)). It is stored as usual for back-off: a probability for
every n-gram seen in training, and for every context the weight MASS / (c(context) + MASS), both as quantised
logarithms. A word takes the probability of its longest n-gram seen, times the weights of the longer contexts.

The word level is written to the shared folder, an Elias-Fano sequence with counts for each shard of words, and
mapped into memory by the tasks that read the texts. These look up the words of a group of texts, add up what
needs single words only, and send each token with its context to the shard of the word before. A shard builds
its trie: contexts from the word before to earlier ones, and for each level of contexts the words that follow.
A level is a monotone sequence of children, each range relative to the end of the range before it, and one of
pointers to the ranges. N-grams are searched in their parent's range on the compact form. What a shard returns
is one sum for each text that has a token there, by group, so no task holds more than a shard and a group.

Null or empty texts hold the end token only. Documents whose crc32 of the doc_id as text is 1 modulo 5
are held out; a null doc_id isn't. Rows that repeat a doc_id count each in training.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.text import buffer, by_bucket, group_starts, mix, slices, unpack, word_values
from lodestat.sources.files import shared_folder

MASS = 50.0
END = np.uint64(0x1234567)
#: Steps of a stored log10 quotient.
STEP = 2.0**-12
#: Bytes of text that are turned into words at once, and that send their tokens together.
SLICE, GROUP = 2 << 20, 8 << 20
#: N-grams that are searched at once.
ASKED = 1 << 17
COUNT = np.dtype([("word", "<u8"), ("n", "<u4")])
DOC = np.dtype([("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8")])
#: Numbers of the start and of all words not seen in training; the others follow, frequent ones first.
START, UNSEEN, FIRST = 0, 1, 2
#: Place of the k-th bit that is set in a byte.
SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)


def _steps(quotient: np.ndarray) -> np.ndarray:
    return np.round(-np.log10(quotient) / STEP).astype(np.int64)


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
    """Place of set bits (with ``flip``, of unset ones) by their rank; ``before``: how many there are before each word."""
    at = np.searchsorted(before, rank, side="right") - 1
    rank = (rank - before[at]).astype(np.uint8)
    found = words[at]
    octets = (~found if flip else found).view(np.uint8).reshape(-1, 8)
    total = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
    k = (total <= rank[:, None]).sum(axis=1)
    row = np.arange(len(k))
    rank -= np.where(k > 0, total[row, k - 1], 0).astype(np.uint8)
    return at * 64 + k * 8 + SELECT[octets[row, k], rank]


class EliasFano:
    """A monotone sequence: low bits as they are, high bits in unary, and the unset bits before each 64 of these."""

    def __init__(self, n: int, shift: int, low: np.ndarray, bits: np.ndarray, zeros: np.ndarray):
        self.n, self.shift, self.low, self.bits, self.zeros = n, np.uint64(shift), low, bits, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        shift = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = (values & np.uint64((1 << shift) - 1)).astype(np.min_scalar_type((1 << shift) - 1))
        place = (values >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        raw = np.zeros(((int(place[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        raw[place] = 1
        bits = np.packbits(raw, bitorder="little").view("<u8")
        return cls(n, shift, low, bits, np.append(0, np.cumsum(64 - np.bitwise_count(bits).astype(np.int64))))

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by place."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        high = _select(self.bits, ones, i, False) - i
        return (high.astype(np.uint64) << self.shift | self.low[i]).astype(np.int64)

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have at most these high bits."""
        inside = (high >= 0) & (high < self.zeros[-1])
        out = np.where(high < 0, 0, self.n)
        out[inside] = _select(self.bits, self.zeros, high[inside], True) - high[inside]
        return out

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Place of each of ``x`` from ``first`` on and before ``end``, or -1: among the values with its high bits, by halves."""
        x = x.astype(np.uint64)
        high = (x >> self.shift).astype(np.int64)
        low = (x & np.uint64((1 << int(self.shift)) - 1)).astype(self.low.dtype)
        a = np.maximum(self._upto(high - 1), first)
        last = np.minimum(self._upto(high), self.n if end is None else end)
        b = last.copy()
        for _ in range(int((b - a).max(initial=0)).bit_length()):
            middle = (a + b) >> 1
            less = (a < b) & (self.low[np.minimum(middle, self.n - 1)] < low)
            a, b = np.where(less, middle + 1, a), np.where(less, b, np.minimum(middle, b))
        hit = a < last
        hit[hit] = self.low[a[hit]] == low[hit]
        return np.where(hit, a, -1)


class Level:
    """Children of nodes: a sequence that begins anew, for each parent, after the last value before, and pointers to its ranges."""

    def __init__(self, parent: np.ndarray, child: np.ndarray, parents: int, quotient: np.ndarray):
        n = len(parent)
        first = np.searchsorted(parent, np.arange(parents + 1))
        filled = first[1:] > first[:-1]
        width = np.zeros(parents, np.int64)
        width[filled] = child[first[1:][filled] - 1] + 1
        self.n, self.pointers = n, EliasFano.of(first)
        self.children = EliasFano.of((np.cumsum(width) - width)[parent] + child)
        self.log = _steps(quotient).astype(np.uint16)

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of each child in its parent's range, or -1; neighbours with one parent take its range once."""
        out = np.full(len(parent), -1)
        asked = np.flatnonzero(parent >= 0)
        if not self.n or not len(asked):
            return out
        parent, child = parent[asked], child[asked]
        at = group_starts(parent)
        first, end = self.pointers.at(parent[at]), self.pointers.at(parent[at] + 1)
        base = np.where(first > 0, self.children.at(np.maximum(first - 1, 0)) + 1, 0)
        n = np.diff(np.append(at, len(parent)))
        out[asked] = self.children.find(np.repeat(base, n) + child, np.repeat(first, n), np.repeat(end, n))
        return out


class Trie:
    """Back-off model of different n-grams in order: ``context`` from the word before to the earliest, ``word``, how often, and its base."""

    def __init__(self, context: list[np.ndarray], word: np.ndarray, count: np.ndarray, p: np.ndarray, width: int):
        self.contexts, self.followers = [], []
        node, nodes = np.zeros(len(word), np.int64), 1
        for c in context:
            at = group_starts(node, c)
            begins = np.zeros(len(word), np.int64)
            begins[at] = 1
            total = np.add.reduceat(count, at) if len(at) else count
            self.contexts.append(Level(node[at], c[at], nodes, MASS / (total + MASS)))
            node, nodes = np.cumsum(begins) - 1, len(at)
            key, of = np.unique(node * width + word, return_inverse=True)
            below = np.zeros(len(key))
            below[of] = p
            parent = key // width
            here = (np.bincount(of, count, len(key)) + MASS * below) / (total[parent] + MASS)
            self.followers.append(Level(parent, key % width, nodes, here))
            p = here[of]

    def log_p(self, context: list[np.ndarray], word: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Steps of the logarithm of the probability of each word; ``base``: of its own."""
        out, node = _steps(base), np.zeros(len(word), np.int64)
        for c, contexts, followers in zip(context, self.contexts, self.followers, strict=True):
            node = contexts.find(node, c)
            known = np.flatnonzero(node >= 0)  # a context not seen changes nothing
            found = followers.find(node[known], word[known])
            if len(known):
                out[known] = np.where(found >= 0, followers.log[found], out[known] + contexts.log[node[known]])
        return out


def _tokens(batch):
    """First and last text of each group, its words with an end each, and the text of each word."""
    data, offsets = buffer(batch.column("text"))
    for first, last in slices(offsets, GROUP):
        words, texts = [], []
        for a, b in slices(offsets[first:last + 1], SLICE):
            a, b = a + first, b + first
            values, _, _, begin = word_values(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lower=True)
            words.append(np.insert(values, begin[1:], END))
            texts.append(np.repeat(np.arange(a - first, b - first), np.diff(begin) + 1))
        yield first, last, np.concatenate(words), np.concatenate(texts)


def _counted(buckets: int):
    def build(batches):
        for batch in batches:
            batch = batch.filter(batch.column("train"))
            for _, _, words, _ in _tokens(batch):
                word, n = np.unique(words, return_counts=True)
                rec = np.zeros(len(word), COUNT)
                rec["word"], rec["n"] = word, n
                out = list(by_bucket((mix(word) % np.uint64(buckets)).astype(np.int32), rec))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "data"])
    return build


WORD_FILE = pa.schema([("n", pa.int64()), ("shift", pa.int64()), *((c, pa.large_binary()) for c in ("low", "bits", "zeros", "counts", "ranks"))])


def _word_level(folder: str, buckets: int):
    """Writes the words of each bucket and how often each was seen; returns the files, tokens and different words."""
    def build(batches):
        parts = [unpack(b.column("data"), COUNT) for b in batches]
        rec = np.concatenate(parts) if parts else np.zeros(0, COUNT)
        rec = rec[np.argsort(rec["word"], kind="stable")]
        at = group_starts(rec["word"])
        word, n = rec["word"][at], np.add.reduceat(rec["n"], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        bucket = (mix(word) % np.uint64(buckets)).astype(np.int32)
        store, root = _store(folder)
        rows = []
        for k in np.unique(bucket).tolist():
            own = bucket == k
            level, counts = EliasFano.of(word[own]), n[own]
            ranks = np.empty(level.n, np.int64)
            ranks[np.argsort(-counts, kind="stable")] = np.arange(level.n)
            path = f"{root}/words-{k}-{uuid.uuid4().hex}.arrow"
            row = [[level.n], [int(level.shift)], *([x.tobytes()] for x in (level.low, level.bits, level.zeros, counts, ranks))]
            with store.open_output_stream(path) as f, pa.ipc.new_file(f, WORD_FILE) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, WORD_FILE, strict=True)], schema=WORD_FILE))
            rows.append((k, path, int(counts.sum()), level.n))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4,
                                                                         (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["bucket", "path", "n", "words"])
    return build


def _seen(store, paths: dict[int, str], buckets: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each word was seen in training and its number, from the mapped files."""
    out, number = np.zeros(len(words), np.int64), np.full(len(words), UNSEEN)
    bucket = (mix(words) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = group_starts(bucket[order])
    for i, j in zip(at, np.append(at[1:], len(order)), strict=True):
        k, own = int(bucket[order[i]]), order[i:j]
        path = paths.get(k)
        if path is None:
            continue
        with store.open_input_file(path) as f:
            row = pa.ipc.open_file(f).get_batch(0)
            n, shift = row.column("n")[0].as_py(), row.column("shift")[0].as_py()
            kinds = {"low": np.min_scalar_type((1 << shift) - 1), "bits": "<u8", "zeros": "<i8", "counts": "<i8", "ranks": "<i8"}
            low, bits, zeros, counts, ranks = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in kinds.items())
            place = EliasFano(n, shift, low, bits, zeros).find(words[own])
            own, place = own[place >= 0], place[place >= 0]
            out[own], number[own] = counts[place], FIRST + ranks[place] * buckets + k
    return out, number


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of the shared folder, which may be written file:/path."""
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", folder))


def _mapped(folder: str):
    """The file system of a folder; a local one maps files into memory."""
    store, _ = _store(folder)
    return fs.LocalFileSystem(use_mmap=True) if isinstance(store, fs.LocalFileSystem) else store


def _small(x: np.ndarray) -> bytes:
    """In the fewest whole bytes an entry, first bytes of all entries first, compressed."""
    x = np.ascontiguousarray(x.reshape(-1), np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + pa.Codec("zstd").compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True)


def _unsmall(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    raw = pa.Codec("zstd").decompress(packed[1:], n * width)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(-1)


def _base(count: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return (count + 0.5) / (tokens + 0.5 * (words + 1))


SENT = ("slice", "bucket", "train", "n", "m", "ids", "names", "counts", "places", "docs")


def _sent(order: int, folder: str, paths: dict[int, str], buckets: int, shards: int, total: tuple[int, int]):
    """For each group a row with what single words tell of its texts, and one for each shard with its tokens.

    Training texts come first in a group, so their number tells which they are.
    """
    def build(batches):
        store, number = _mapped(folder), TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(~batch.column("train").to_numpy(zero_copy_only=False), kind="stable")))
            for a, b, words, text in _tokens(batch):
                train = int(batch.column("train")[a:b].to_numpy(zero_copy_only=False).sum())
                names, word = np.unique(words, return_inverse=True)
                count, known = _seen(store, paths, buckets, names)
                log = np.log10(_base(count, *total))[word]
                doc = np.zeros(b - a, DOC)
                doc["n_tokens"] = np.bincount(text, minlength=b - a)
                doc["n_known"] = np.bincount(text, (count > 0)[word], b - a)
                doc["base"] = np.bincount(text, log, b - a)
                names = np.unique(np.append(known, START))
                short = np.searchsorted(names, known).astype(np.int32)
                counts = np.zeros(len(names), np.int64)
                counts[short] = count
                word = short[word]
                place = np.arange(len(word)) - np.repeat(np.searchsorted(text, np.arange(b - a)), doc["n_tokens"])
                parts = [word, *(np.where(place >= d, np.roll(word, d), 0) for d in range(1, order))]
                # after a word not seen there is no n-gram, and the word has its base
                after = names[parts[1]] != UNSEEN
                doc["score"] = np.bincount(text[~after], log[~after], b - a)
                rows = [(number, number % shards, train, 0, 0, batch.column("doc_id")[a:b].to_pylist(), b"", b"", b"", doc.tobytes())]
                shard = (mix(names) % np.uint64(shards)).astype(np.uint16 if shards < 1 << 16 else np.uint32)[parts[1]]
                by = np.flatnonzero(after)
                by = by[np.argsort(shard[by], kind="stable")]
                at = group_starts(shard[by])
                mark, here = np.zeros(len(names), bool), np.zeros(len(names), np.int32)
                for i, j in zip(at, np.append(at[1:], len(by)), strict=True):
                    own = by[i:j]
                    places = np.stack([x[own] for x in parts])
                    mark[places] = True
                    used = np.flatnonzero(mark)
                    mark[used] = False
                    here[used] = np.arange(len(used))
                    rows.append((number, int(shard[own[0]]), train, len(own), len(used), None, _small(np.diff(names[used], prepend=0)), _small(counts[used]),
                                 _small(here[places]), _small(np.diff(text[own], prepend=0))))
                types = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.list_(batch.schema.field("doc_id").type), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(SENT))
                number += 1
    return build


def _shard_scores(order: int, tokens: int, words: int, rows: list[dict]):
    """Sums of each text for the rows of one shard: builds its trie from the training texts and searches all n-grams in it."""
    n = np.array([r["n"] for r in rows])
    names = [np.cumsum(_unsmall(r["names"], r["m"]), dtype=np.int64) for r in rows]
    count = np.concatenate([_unsmall(r["counts"], r["m"]) for r in rows]).astype(np.int64)
    skip = np.cumsum([0, *map(len, names)])
    names, of = np.unique(np.concatenate(names), return_inverse=True)
    of = of.astype(np.int32)
    base = np.zeros(len(names))
    base[of] = _base(count, tokens, words)
    width = len(names)
    parts = [np.concatenate([of[skip[i]:skip[i + 1]][_unsmall(r["places"], order * r["n"]).reshape(order, -1)[d]] for i, r in enumerate(rows)])
             for d in range(order)]
    text = np.concatenate([np.cumsum(_unsmall(r["docs"], r["n"]), dtype=np.int32) for r in rows])
    learned = text < np.repeat([r["train"] for r in rows], n)
    # different n-grams in order of context, each step's numbers from the one before
    steps, node = [], np.zeros(len(text), np.int64)
    for c in [*parts[1:], parts[0]]:
        key, node = np.unique(node * width + c, return_inverse=True)
        steps.append(key)
    del parts
    which, key = node.astype(np.int32), steps.pop()
    word, context = (key % width).astype(np.int32), []
    for step in reversed(steps):
        key = step[key // width]
        context.insert(0, (key % width).astype(np.int32))
    del key, node, steps
    count = np.bincount(which[learned], minlength=len(word))
    seen = count > 0
    trie = Trie([c[seen] for c in context], word[seen], count[seen], base[word[seen]], width)
    log_p = np.concatenate([trie.log_p([c[i:i + ASKED] for c in context], word[i:i + ASKED], base[word[i:i + ASKED]]).astype(np.int32)
                            for i in range(0, len(word), ASKED)])
    row = np.repeat(np.arange(len(rows)), n)
    at = group_starts(row, text)
    sums, cut = np.add.reduceat(log_p[which], at, dtype=np.int64), np.searchsorted(row[at], np.arange(len(rows) + 1))
    for r, i, j in zip(rows, cut[:-1], cut[1:], strict=True):
        yield r["slice"], r["train"], j - i, None, _small(np.diff(text[at[i:j]], prepend=0)), _small(sums[i:j])


SCORED = ("slice", "train", "n", "ids", "docs", "sums")


def _scored(order: int, total: tuple[int, int]):
    """Shards come one after the other; rows of groups are passed on."""
    def batch_of(rows, ids):
        types = (*[pa.int64()] * 3, ids, pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(SCORED))

    def build(batches):
        shard, rows = None, []
        for batch in batches:
            ids = batch.schema.field("ids").type
            for r in batch.to_pylist():
                if r["ids"] is not None:
                    yield batch_of([(r["slice"], r["train"], 0, r["ids"], r["docs"], None)], ids)
                    continue
                if r["bucket"] != shard and rows:
                    yield batch_of(list(_shard_scores(order, *total, rows)), ids)
                    rows = []
                shard = r["bucket"]
                rows.append(r)
        if rows:
            yield batch_of(list(_shard_scores(order, *total, rows)), ids)
    return build


def _summed(tokens: int):
    """Rows of documents from those of each group, which come one group after the other."""
    def whole(rows, ids):
        head = next(r for r in rows if r["ids"] is not None)
        doc, steps = np.frombuffer(head["docs"], DOC), np.zeros(len(head["ids"]), np.int64)
        for r in rows:
            if r["ids"] is None:
                steps[np.cumsum(_unsmall(r["docs"], r["n"]), dtype=np.int64)] += _unsmall(r["sums"], r["n"]).astype(np.int64)
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(head["ids"], ids.value_type), pa.array(np.arange(n) >= head["train"]), pa.array(doc["n_tokens"].copy()),
                                           pa.array(doc["n_known"].copy()), pa.array(np.full(n, tokens, np.int64)), pa.array(doc["base"].copy()), pa.array(doc["score"] - STEP * steps)],
                                          ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def build(batches):
        rows = []
        for batch in batches:
            ids = batch.schema.field("ids").type
            for r in batch.to_pylist():
                if rows and rows[0]["slice"] != r["slice"]:
                    yield whole(rows, ids)
                    rows = []
                rows.append(r)
        if rows:
            yield whole(rows, ids)
    return build


def scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs; ``order``: words of an n-gram, 2 or more."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, folder = 2 * parts, shared_folder(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", (~held).alias("train"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    files = (rows.select("text", "train").mapInArrow(_counted(parts), "bucket int, data binary").repartition(parts, "bucket").select("data")
             .mapInArrow(_word_level(folder, parts), "bucket int, path string, n long, words long").collect())
    total = sum(r["n"] for r in files), sum(r["words"] for r in files)
    paths = {r["bucket"]: r["path"] for r in files}
    sent = rows.mapInArrow(_sent(order, folder, paths, parts, shards, total),
                           f"slice long, bucket int, train long, n long, m long, ids array<{id_type}>, names binary, counts binary, places binary, docs binary")
    scored = (sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
              .mapInArrow(_scored(order, total), f"slice long, train long, n long, ids array<{id_type}>, docs binary, sums binary"))
    return (scored.repartition(parts, "slice").sortWithinPartitions("slice")
            .mapInArrow(_summed(total[0]), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
