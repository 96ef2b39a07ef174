"""Trie of the prefixes of many conversations, built by cutting sequences at half their depth.

Every span of depths is cut in its middle. The prefix that ends at the cut is named; the upper trie
holds what lies before the cut, one lower forest hangs at each name. Both halves are cut again, and as a
name is the exclusive or of the names of its pieces, all cuts of all spans are named at the same time:
depth d is the cut of one span only, of twice the largest power of two that divides d. So a turn goes
into the pieces before at most log2(length) cuts, and a name is put together from at most as many pieces
(128 bits; turns that differ in depth or content have different pieces). A node is a name; it is
called by its smallest conversation and its depth.

Totals of subtrees are first summed inside spans of ``BASE`` turns. Then neighbouring spans are joined,
twice as long each round: the totals of a lower forest are summed under the name it hangs at and grafted
to that node and the nodes above it in the upper span. The rounds grow with the logarithm of the
longest conversation. No conversation, node or list of members is gathered in one task; only the hash of
the conversations that end at a node reads their ids, packed by 4096, one after the other.

Results for special input: a null conv_id names no conversation and its rows are left out; null role or
text is empty; a null turn comes first; rows with the same turn are ordered by their content; equal rows
are turns of their own; a conversation left without turns is a member of the root; an empty table has no
nodes; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.positions import numbered
from lodestat.sources.files import stored

#: Turns of the spans in which totals are summed directly, as a power of two.
BASE = 3
#: Conversation ids packed into one text are those with the same id divided by 2 to this.
PACK = 12


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n (turns of the conversation), mark (of role and text) and size (bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("size"))
    return stored(numbered(rows, ["conv_id"], ["turn", "mark"]))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, len), and their turns (conv, len, d from 1 up, mark, size).

    Conversation c begins with the first crc32(c) % most turns of conversation c - c % family and goes on
    with its own turns after as many.
    """
    own = turns.groupBy("conv_id").agg(F.max("n").alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "first": F.col("conv_id") - F.col("conv_id") % family})
    own = stored(own)
    take = F.least("h", F.coalesce("m", F.lit(0)))
    convs = stored(own.join(own.select(F.col("conv_id").alias("first"), F.col("n").alias("m")), "first", "left").select(
        F.col("conv_id").alias("conv"), "first", "h", take.cast("long").alias("take"), (take + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len")))
    taken = (turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "first").join(convs, "first").where("pos < take")
             .select("conv", "len", (F.col("pos") + 1).alias("d"), "mark", "size"))
    kept = (turns.withColumnRenamed("conv_id", "conv").join(convs.drop("first"), "conv").where("pos >= h")
            .select("conv", "len", (F.col("pos") - F.col("h") + F.col("take") + 1).alias("d"), "mark", "size"))
    return convs.select("conv", "len"), taken.union(kept)


def _lowest(c: Column) -> Column:
    """Largest power of two that divides a positive number."""
    return c.bitwiseAND(-c)


def named(turns: DataFrame) -> DataFrame:
    """Turns with the name of the prefix that ends in them (a1, a2), and without their own piece (p1, p2)."""
    cuts = F.expr("""filter(transform(sequence(0, length(bin(len)) - 1), k -> named_struct('size', shiftleft(1L, k), 'at', shiftleft(shiftright(d - 1, k) + 1, k))),
                     x -> x.at <= len AND x.at & -x.at = x.size)""")
    pieces = turns.withColumns({"k1": F.xxhash64("d", "mark"), "k2": F.xxhash64("mark", "d", F.lit(1))})
    pieces = pieces.select("conv", "len", "d", "k1", "k2", "size", F.explode(cuts).alias("cut"))
    pieces = pieces.withColumn("at", F.col("cut")["at"])
    own = F.col("d") == F.col("at")
    pieces = pieces.groupBy("conv", "at").agg(
        F.max("len").alias("len"), F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("k1", "k2", "size")])
    users = pieces.withColumn("d", F.explode(F.sequence("at", F.least(F.col("at") + _lowest(F.col("at")) - 1, F.col("len")))))
    own = F.col("d") == F.col("at")
    return (users.groupBy("conv", "d").agg(
        F.max("len").alias("len"), F.bit_xor("b1").alias("a1"), F.bit_xor("b2").alias("a2"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("k1", "k2", "size")])
        .select("conv", "d", "len", "a1", "a2", "size", F.col("a1").bitwiseXOR(F.col("k1")).alias("p1"), F.col("a2").bitwiseXOR(F.col("k2")).alias("p2")))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of each (rep, d), which come sorted."""
    def row(key, h):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([h.hexdigest()])], ["rep", "d", "ends"])

    key, h = None, None
    for batch in batches:
        for rep, d, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "d", "ids")), strict=True):
            if key != (rep, d):
                if key is not None:
                    yield row(key, h)
                key, h = (rep, d), hashlib.sha256()
                h.update(text.encode())
            else:
                h.update(b"," + text.encode())
    if key is not None:
        yield row(key, h)


def _ends(at: DataFrame) -> DataFrame:
    """rep, d, ends: hash of the ids that end at a node, from rows (rep, d, conv)."""
    packed = at.groupBy("rep", "d", F.shiftright("conv", PACK).alias("pack")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return (packed.repartition("rep", "d").sortWithinPartitions("rep", "d", "pack").select("rep", "d", "ids")
            .mapInArrow(_hashes, "rep long, d long, ends string"))


def _totals(nodes: DataFrame, paths: DataFrame, deepest: int) -> list[DataFrame]:
    """Tables (rep, d, leaves, saved) whose sums by (rep, d) are the totals of subtrees, root left out."""
    span = lambda c, k: F.shiftright(F.col(c) - 1, k)
    above = paths.select(F.col("conv").alias("from"), F.col("d").alias("up_d"), F.col("rep").alias("up"), "len")
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    upward = lambda rows: rows.groupBy(F.col("up").alias("rep"), F.col("up_d").alias("d")).agg(*sums)
    own = nodes.select(F.col("rep").alias("from"), "d", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), "saved")
    inside = own.withColumn("span", span("d", BASE)).join(above.withColumn("span", span("up_d", BASE)), ["from", "span"]).where("up_d <= d")
    found = [stored(upward(inside))]
    k = BASE
    while 1 << k < deepest:
        # heads of the forests below a cut, and the upper spans of conversations that go beyond it
        head = (F.col("d") > 1) & ((F.col("d") - 1) % (1 << k) == 0) & (span("d", k) % 2 == 1)
        upper = above.where((span("up_d", k) % 2 == 0) & (F.col("len") > F.shiftleft(span("up_d", k) + 1, k)))
        heads = found[0].where(head)
        for more in found[1:]:
            heads = heads.union(more.where(head))
        forests = (heads.join(nodes.where(head).select("rep", "d", "parent"), ["rep", "d"]).groupBy(F.col("parent").alias("from"), "d").agg(*sums)
                   .withColumn("span", span("d", k) - 1))
        found.append(stored(upward(forests.join(upper.withColumn("span", span("up_d", k)), ["from", "span"]))))
        k += 1
    return found


def tree(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of conversations (conv, len), a stored table, with turns (conv, len, d, mark, size); see ``trie``."""
    first, deepest = convs.agg(F.min("conv"), F.max("len")).first()
    rows = stored(named(turns))
    names = stored(rows.groupBy("d", "a1", "a2").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"),
                                                     F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    key = names.select("d", "a1", "a2", "rep")
    paths = stored(rows.select("conv", "len", "d", "a1", "a2").join(key, ["d", "a1", "a2"]).select("conv", "len", "d", "rep"))
    parents = key.select((F.col("d") + 1).alias("d"), F.col("a1").alias("p1"), F.col("a2").alias("p2"), F.col("rep").alias("parent"))
    nodes = stored(names.join(parents, ["d", "p1", "p2"], "left").select(
        "rep", "d", F.coalesce("parent", F.lit(first)).cast("long").alias("parent"), "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    children = nodes.groupBy(F.col("parent").alias("rep"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["rep", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    nothing = lambda c, kind="long": F.lit(None).cast(kind).alias(c)
    root = convs.agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    tops = nodes.where("d = 1").agg(F.count(F.lit(1)).alias("n"))
    facts = [nodes.select("rep", "d", "parent", "n_convs", "n_children", nothing("leaves"), nothing("saved"), nothing("ends", "string")),
             root.select("rep", F.lit(0).cast("long").alias("d"), nothing("parent"), "n_convs", nothing("n_children"), nothing("leaves"), nothing("saved"), nothing("ends", "string"))]
    part = lambda rep, d, **given: [rep.cast("long").alias("rep"), d.cast("long").alias("d"), *[
        given[c].alias(c) if c in given else nothing(c, "string" if c == "ends" else "long") for c in ("parent", "n_convs", "n_children", "leaves", "saved", "ends")]]
    home = F.lit(first)
    if first is not None:
        facts.append(tops.select(*part(home, F.lit(0), n_children=F.col("n"), leaves=F.when(F.col("n") == 0, 1).otherwise(0).cast("long"))))
    for sums in _totals(nodes, paths, deepest or 0):
        facts.append(sums.select(*part(F.col("rep"), F.col("d"), leaves=F.col("leaves"), saved=F.col("saved"))))
        facts.append(sums.where("d = 1").select(*part(home, F.lit(0), leaves=F.col("leaves"), saved=F.col("saved"))))
    ends = _ends(paths.where("d = len").select("rep", "d", "conv").union(
        convs.where("len = 0").select(home.cast("long").alias("rep"), F.lit(0).cast("long").alias("d"), "conv")))
    facts.append(ends.select(*part(F.col("rep"), F.col("d"), ends=F.col("ends"))))
    whole = facts[0]
    for more in facts[1:]:
        whole = whole.union(more)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return whole.groupBy("rep", "d").agg(
        F.max("parent").alias("parent_conv_id"), total("n_convs").alias("n_convs"), total("n_children").alias("n_children"),
        total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    ).select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return tree(*rebuilt(turns_of(conversations)))
