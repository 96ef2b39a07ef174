"""Join of documents whose sets of word shingles have at least a given Jaccard similarity.

Documents with equal sets are one class from the start; a class is named by its set's fingerprint.
Different sets meet in groups. Sets of fewer than ``CELLS_FROM`` shingles share one of their smallest
fingerprints if they are linked; larger ones are cut into cells by fingerprint, more cells than two
linked sets of that size can differ in, so that one cell at least is equal. In each group first the
smallest class is compared with the others, and the links found give components. Groups that hold
several components still are searched by signature tree: nodes hold the union of their members'
token bitmaps, the range of their sizes and their component if it is one; two trees are walked at
once, and a pair of nodes goes no further if its sizes, its largest possible overlap or its component
rules it out. All pairs that are left are checked on the whole sets, in a crowded group first a few
of each set, as the links among these leave few pairs between components. So no link between
components is lost, and no group is ever turned into all its pairs.

A-Z are lower-cased; words are runs of characters other than ASCII white space. A text with fewer
words than a shingle is one shingle; null and blank texts have an empty set, link with nothing and
are their own component. Rows that repeat a doc_id are compared like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.components import components
from lodestat.llm.repeats import with_keys
from lodestat.llm.text import Fingerprints, buffer, by_bucket, group_starts, mix, slices, unpack, word_values
from lodestat.sources.files import bucketed, stored

#: Sets from this size on are compared by cells, in classes of size of this ratio.
CELLS_FROM, RATIO = 64, 1.5
#: Members of a leaf, and children of a node, of a signature tree.
FAN = 16
#: Members that one side of a task of the tree search holds, on average.
PART = 2048
#: Groups of each set that are searched first.
FEW = 8
#: Candidates of each set that are looked at before all others, and how often.
SOME, WAVES = 8, 2
POSTING = np.dtype([("key", "<u8"), ("set", "<i8")])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Sorted distinct shingle fingerprints of all texts, and where each text's begin."""
    values, _, _, begin = word_values(data, offsets, lower=True)
    prints = Fingerprints(values)
    words = np.diff(begin)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    at = np.append(0, np.cumsum(count))
    first = np.repeat(begin[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
    h = prints.of(first, first + np.repeat(np.minimum(words, k), count))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][count > 0]] = True
    return h[new], np.append(0, np.cumsum(new))[at]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each range between neighbouring places, modulo 2**64."""
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return total[at[1:]] - total[at[:-1]]


def set_names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprint of each set; 0 for the empty one."""
    size = np.diff(at).astype(np.uint64)
    names = mix(_sums(mix(h), at) + mix(size))
    return np.where(size > 0, names, np.uint64(0)).view(np.int64)


def size_classes(top: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest size, most differences and number of cells of every class up to size ``top``."""
    low = [CELLS_FROM]
    while low[-1] <= top:
        low.append(int(np.ceil(low[-1] * RATIO)))
    low = np.array(low, np.int64)
    differ = (low[1:] - 1) * (den - num) // num
    return low, differ, np.ceil((differ + 1) * 1.06).astype(np.int64) + 2


def postings(h: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Group keys of each set, and the set each belongs to."""
    size = np.diff(at)
    least = -(-size * num // den)  # a linked set is no smaller
    keys, owner = [], []
    small = np.flatnonzero((size > 0) & (least < CELLS_FROM))
    p = (size - least + 1)[small]
    place = np.repeat(at[:-1][small], p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
    keys.append(mix(h[place] ^ np.uint64(0xA5A5A5A5)))
    owner.append(np.repeat(small, p))
    low, differ, cells = size_classes(int(size.max(initial=0)), num, den)
    own = np.searchsorted(low, size, side="right") - 1
    lowest = np.maximum(np.searchsorted(low, least, side="right") - 1, 0)
    mixed = mix(h + np.uint64(1))
    for down in range(int((own - lowest).max(initial=0)) + 1):
        sets = np.flatnonzero((size >= CELLS_FROM) & (own - down >= lowest))
        if not len(sets):
            continue
        kind = own[sets] - down
        n = size[sets]
        place = np.repeat(at[:-1][sets], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(len(sets)), n)
        cell = ((h[place] >> np.uint64(32)) * np.repeat(cells[kind].astype(np.uint64), n)) >> np.uint64(32)
        start = group_starts(of, cell)
        sums = _sums(mixed[place], np.append(start, len(place)))
        of, cell = of[start], cell[start]
        keys.append(mix(sums ^ mix((kind[of].astype(np.uint64) << np.uint64(40)) + cell)))
        owner.append(sets[of])
        filled = np.bincount(of, minlength=len(sets))
        for i in np.flatnonzero(filled <= differ[kind]):  # then an empty cell may be the only equal one
            empty = np.setdiff1d(np.arange(cells[kind[i]]), cell[of == i].astype(np.int64)).astype(np.uint64)
            keys.append(mix(mix((np.uint64(kind[i]) << np.uint64(40)) + empty)))
            owner.append(np.full(len(empty), sets[i]))
    return np.concatenate(keys), np.concatenate(owner)


def _sets_of(batch, k: int):
    data, offsets = buffer(batch.column("text"))
    for a, b in slices(offsets):
        yield a, b, *shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k)


def _named(k: int):
    def build(batches):
        for batch in batches:
            for a, b, h, at in _sets_of(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[a:b] for c in ("doc_id", "_doc", "_row")), pa.array(set_names(h, at)), pa.array(np.diff(at))],
                    ["doc_id", "_doc", "_row", "set", "n_shingles"])
    return build


def _posted(k: int, num: int, den: int, buckets: int):
    def build(batches):
        for batch in batches:
            for _, _, h, at in _sets_of(batch, k):
                names = set_names(h, at)
                _, first = np.unique(names, return_index=True)
                keep = np.zeros(len(names), bool)
                keep[first] = True
                keep &= np.diff(at) > 0
                h = h[np.repeat(keep, np.diff(at))]
                at = np.append(0, np.cumsum(np.diff(at)[keep]))
                if not len(h):
                    continue
                keys, owner = postings(h, at, num, den)
                rec = np.zeros(len(keys), POSTING)
                rec["key"], rec["set"] = keys, names[keep][owner]
                out = list(by_bucket((mix(keys) % np.uint64(buckets)).astype(np.int32), rec))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())],
                                                 ["bucket", "data"])
    return build


def _meet(batches):
    """Pairs (smallest set, other set) of each group, and groups of over two with their members."""
    parts = [unpack(b.column("data"), POSTING) for b in batches]
    rec = np.concatenate(parts) if parts else np.zeros(0, POSTING)
    rec = rec[np.lexsort((rec["set"], rec["key"]))]
    rec = rec[group_starts(rec["key"], rec["set"])]
    at = group_starts(rec["key"])
    n = np.diff(np.append(at, len(rec)))
    other = np.ones(len(rec), bool)
    other[at] = False
    pairs = np.unique(np.stack([rec["set"][np.repeat(at, n)][other], rec["set"][other]], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.binary())], ["a", "b", "members"])
    big = n > 2
    name = _sums(mix(rec["set"].view(np.uint64)), np.append(at, len(rec)))
    _, first = np.unique(name[big], return_index=True)
    at, n, name = at[big][first], n[big][first], name[big][first]
    members = [rec["set"][i:i + m].tobytes() for i, m in zip(at, n, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.nulls(len(at), pa.int64()), pa.array(members, pa.binary())],
                                     ["a", "b", "members"])


def _bitmap(h: np.ndarray) -> bytes:
    bits = max(64, 1 << int(2 * len(h)).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _fetched(k: int):
    def build(batches):
        for batch in batches:
            for a, b, h, at in _sets_of(batch, k):
                sets = [h[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("set")[a:b], pa.array(np.diff(at)), pa.array([_bitmap(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["set", "size", "bits", "hashes"])
    return build


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap of fewer bits, each the union of those that fall on it."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0)


def needed(n, m, num: int, den: int):
    """Least overlap of linked sets of n and m items."""
    return -(-(n + m) * num // (num + den))


def _possible(num: int, den: int):
    """Pairs whose sizes and bitmaps allow a link."""
    def build(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b"))
            keep = np.minimum(n, m) * den >= np.maximum(n, m) * num
            for i in np.flatnonzero(keep):
                x, y = (batch.column(c)[int(i)].as_py() for c in ("bits_a", "bits_b"))
                width = min(len(x), len(y))
                x, y = _folded(x, width), _folded(y, width)
                both = int(np.bitwise_count(x & y).sum())
                most = min(n[i] - int(np.bitwise_count(x).sum()), m[i] - int(np.bitwise_count(y).sum())) + both
                keep[i] = most >= needed(n[i], m[i], num, den)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])
    return build


def _linked(num: int, den: int):
    """Pairs that are linked, by their whole sets."""
    def build(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])
    return build


class Tree:
    """Signature tree over sets in order of size; level 0 are the sets themselves."""

    def __init__(self, size, bits, label):
        order = np.lexsort((label, size))
        self.order = order
        size, bits, label = size[order], bits[order], label[order]
        excess = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, size, size, excess, label, label)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess, first, last = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(excess, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def pairs(self, num: int, den: int):
        """Places of sets of different labels that may be linked: walks the tree against itself."""
        top = len(self.levels) - 1
        x = y = np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            if not len(x):
                break
            bits, low, high, excess, first, last = self.levels[level]
            keep = []
            for i in range(0, len(x), 65536):
                a, b = x[i:i + 65536], y[i:i + 65536]
                ok = ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
                ok &= (high[a] * den >= low[b] * num) & (high[b] * den >= low[a] * num)
                at = np.flatnonzero(ok)
                a, b = a[at], b[at]
                both = np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64)
                ok[at] = np.minimum(excess[a], excess[b]) + both >= needed(low[a], low[b], num, den)
                keep.append(ok)
            keep = np.concatenate(keep)
            x, y = x[keep], y[keep]
            if level:
                below = len(self.levels[level - 1][0])
                i, j = np.divmod(np.arange(FAN * FAN), FAN)
                x, y = ((v[:, None] * FAN + k).reshape(-1) for v, k in ((x, i), (y, j)))
                keep = (x < below) & (y < below) & (x <= y if level > 1 else x < y)
                x, y = x[keep], y[keep]
        different = x != y
        return self.order[x[different]], self.order[y[different]]


def _met_before(x: np.ndarray, y: np.ndarray, group: int, again: bool) -> np.ndarray:
    """Whether two sets share one of their first groups: any of them if those are done, else one before this."""
    out = np.zeros(len(x), bool)
    for i in range(FEW):
        for j in range(FEW):
            out |= (x[:, i] == y[:, j]) & (x[:, i] != 0) & (again | (x[:, i] < group))
    return out


def _walked(num: int, den: int, again: bool, some: int | None = None, wave: int = 0):
    """Pairs that may be linked; with ``some``, about as many of each set, others in each wave, and whether some were left out."""
    def build(table: pa.Table) -> pa.Table:
        names, size, label, own, upper = (table.column(c).to_numpy(zero_copy_only=False) for c in ("set", "size", "label", "own", "upper"))
        blobs = table.column("bits").to_pylist()
        width = min(map(len, blobs))
        bits = np.stack([_folded(b, width) for b in blobs])
        a, b = Tree(size, bits, label).pairs(num, den)
        # two sets above the cell's band meet in the next cell, two of one part where it meets itself
        here = ~(upper[a] & upper[b]) & ((own[a] != own[b]) | (table.column("i")[0].as_py() == table.column("j")[0].as_py()))
        a, b = a[here], b[here]
        first = np.array([f + [0] * (FEW - len(f)) for f in table.column("first").to_pylist()], np.int64)
        new = ~_met_before(first[a], first[b], table.column("group")[0].as_py(), again)
        a, b = names[a[new]], names[b[new]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        most = len(a) if some is None else max(1, some * len(names) // table.column("parts")[0].as_py())
        cut = len(a) > most
        if cut:
            chosen = np.argpartition(mix(mix(a.view(np.uint64) + np.uint64(wave)) ^ b.view(np.uint64)), most)[:most]
            a, b = a[chosen], b[chosen]
        return pa.table({"a": a, "b": b, "cut": np.full(len(a), cut)})
    return build


def _parted(member: DataFrame, num: int, den: int) -> DataFrame:
    """Members of groups with several components, dealt to tasks of at most about twice PART members.

    Linked sets lie in the same band of sizes or in neighbouring ones, so a cell is a band and the one
    above it. A crowded cell is cut into parts by hash and every two parts, and each with itself, meet.
    """
    step = float(np.log(den / num) * 1.001) if num < den else 1e-9
    band = F.floor(F.log(F.col("size").cast("double")) / step)
    cells = member.withColumn("at", F.explode(F.array(F.struct(band.alias("cell"), F.lit(False).alias("upper")),
                                                      F.struct((band - 1).alias("cell"), F.lit(True).alias("upper"))))).select("group", "set", "size", "label", "at.*")
    mixed = stored(cells.groupBy("group", "cell").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.bool_and("upper").alias("above"), F.count("*").alias("n"))
                   .where("x <> y and not above").select("group", "cell", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")
    return (cells.join(mixed, ["group", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("group", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "parts", "own", "upper", "set", "size", "label"))


def _with_sets(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int, walked: bool = False) -> DataFrame:
    """The linked ones of pairs; a tree walk has been over the bitmaps of ``walked`` ones."""
    if not walked:
        pairs = stored(_with_sets(pairs, sets, "size", "bits").mapInArrow(_possible(num, den), "a long, b long"))
    # whole sets are large: those of no pair stay in their buckets, unsorted. The others are dealt anew, by ``set``, so that a crowded one can be split
    ends = pairs.select(F.bitwise_not("a").alias("place")).union(pairs.select(F.bitwise_not("b").alias("place"))).distinct()
    sets = sets.join(ends.hint("shuffle_hash"), "place", "left_semi")
    return stored(_with_sets(pairs, sets, "hashes").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_linked(num, den), "a long, b long"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Classes and links of documents whose shingle sets have a similarity of ``percent`` or more.

    The first table has doc_id, the row keys, n_shingles, ``set`` (equal for equal sets), component_id and
    ``kept`` (true in one row of each component, or in its identical rows) for each row of docs; the second pairs of sets: those that join components, not all links in a group.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    num, den = percent, 100
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = with_keys(docs)
    named = stored(keyed.mapInArrow(_named(k), f"doc_id {kind}, _doc long, _row long, set long, n_shingles long"))
    met = stored(keyed.select("text").mapInArrow(_posted(k, num, den, 4 * parts), "bucket int, data binary")
                 .repartition(parts, "bucket").select("data").mapInArrow(_meet, "a long, b long, members binary"))
    pairs = stored(met.where("members is null").select("a", "b").distinct())
    wanted = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("set"))
    holder = named.join(wanted, "set").groupBy("set").agg(F.min(F.struct("_doc", "_row")).alias("at")).select("set", "at.*")
    sets = bucketed(keyed.join(holder, ["_doc", "_row"]).dropDuplicates(["_doc", "_row"]).select("set", "text").repartition(parts, F.bitwise_not("set"))
                    .mapInArrow(_fetched(k), "set long, size long, bits binary, hashes binary").withColumn("place", F.bitwise_not("set")), "place", parts)
    links = _checked(pairs, sets, num, den)
    labels = components(links)
    groups = met.where("members is not null").dropDuplicates(["a"]).select(F.col("a").alias("group"), "members")
    member = stored(groups.mapInArrow(_members, "group long, set long").join(sets.select("set", "size"), "set"))
    # near copies meet in many groups: most are joined in a few groups of each first, so that the others hold one component
    # and a pair is taken up only in the first of those that its sets share
    few = stored(member.groupBy("set").agg(F.slice(F.array_sort(F.collect_set("group")), 1, FEW).alias("first")))
    chosen = few.select("set", F.explode("first").alias("group"))
    for searched, again in ((member.join(chosen, ["set", "group"], "left_semi"), False), (member, True)):
        for wave, some in enumerate([SOME] * WAVES + [None]):
            labelled = stored(searched.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set")))
            found = stored(_parted(labelled, num, den).join(sets.select("set", "bits"), "set").join(few, "set")
                           .groupBy("group", "cell", "i", "j").applyInArrow(_walked(num, den, again, some, wave), "a long, b long, cut boolean"))
            more = _checked(found.select("a", "b").distinct(), sets, num, den, walked=True)
            if not more.isEmpty():
                links = stored(links.union(more))
                labels = components(links)
            if found.where("cut").isEmpty():
                break  # no pair was left out
    of = named.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = stored(of.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("_doc", "_row")).alias("_first")))
    rows = of.join(least, "label", "left").select(
        "doc_id", "_doc", "_row", "n_shingles", "set", F.coalesce(F.col("_first") == F.struct("_doc", "_row"), F.lit(True)).alias("kept"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return rows, links


def _members(batches):
    for batch in batches:
        found = [np.frombuffer(x, np.int64) for x in batch.column("members").to_pylist()]
        n = [len(x) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("group").to_numpy(), n)),
                                          pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["group", "set"])
