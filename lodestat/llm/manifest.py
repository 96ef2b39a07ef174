"""Merkle manifest of a table: a hash tree per group of rows, and one over the groups.

The nodes of a level are numbered without gaps, and a node is kept in the row of its first leaf. So
lag and lead by fixed offsets (the width of a node, once, twice, ...) reach a node's neighbours; the
slot of a node in its run and the length of the run mask those that are no siblings. Rows that are a
run's first child hash the run into the parent. Several levels are done in one shuffle: rows are dealt
by group and block of ``fan_in ** LEVELS`` places, so a large group spreads over many tasks. What
remains of each block is a row of the next table, until every group is down to one node.

Results for special input: null values are written ``-``; a null group is a group of its own, before
the others; rows with the same or no order value are ordered by their leaf; equal rows are separate
leaves; an empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.positions import numbered
from lodestat.operators.relate import attach
from lodestat.sources.files import stored

#: Levels of the tree done by one shuffle.
LEVELS = 7
#: Fixed value: a null field of a leaf.
MISSING = "-"


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order, each with the number of its UTF-8 bytes."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.when(t.isNull(), MISSING).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                             for t in texts]), 256)


def _fold_block(nodes: DataFrame, group: list[str], fan_in: int) -> DataFrame:
    """``nodes`` (pos, n, node) with ``path``, siblings to the left and right level by level inside the
    block, and ``top``, the node that the block becomes, in the block's first row."""
    size = fan_in ** LEVELS
    block = Window.partitionBy(*group, "_block").orderBy("pos")
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    pos, n = F.col("pos"), F.col("n")
    rows = nodes.withColumn("_block", F.floor(pos / size)).withColumn("_d0", F.col("node"))
    names = []
    for level in range(LEVELS):
        width, digest = fan_in ** level, F.col(f"_d{level}")
        index = F.floor(pos / width)
        slot = index % fan_in
        run = F.least(F.lit(fan_in), F.ceil(n / width) - index + slot)
        is_node = (pos % width == 0) & (n > width)
        left = [F.when(slot >= o, F.lag(digest, width * o).over(block)).otherwise("") for o in range(fan_in - 1, 0, -1)]
        right = [F.when(slot + o < run, F.lead(digest, width * o).over(block)).otherwise("") for o in range(1, fan_in)]
        rows = rows.withColumns({f"_l{level}": F.when(is_node, F.concat(*left)), f"_r{level}": F.when(is_node, F.concat(*right))})
        rows = rows.withColumn(f"_d{level + 1}", F.when(pos % (width * fan_in) == 0, F.when(
            n > width, F.sha2(F.concat(digest, F.col(f"_r{level}")), 256)).otherwise(digest)))
        names += [f"_l{level}", f"_r{level}"]
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in names})
    path = F.filter(F.array(*[F.struct(F.col(f"_l{i}").alias("left"), F.col(f"_r{i}").alias("right")) for i in range(LEVELS)]),
                    lambda x: x["left"].isNotNull())
    return rows.select(*nodes.columns, path.alias("path"), F.col(f"_d{LEVELS}").alias("top"))


def fold(nodes: DataFrame, group: list[str], largest: int, fan_in: int = 2) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (group, pos, n, node and others) with the whole ``path`` from each node to its group's
    top; and the ``top`` of each group. ``largest`` is the size of the largest group."""
    size = fan_in ** LEVELS
    tables = [stored(_fold_block(nodes, group, fan_in))]
    while (largest := -(-largest // size)) > 1:
        blocks = tables[-1].where(F.col("top").isNotNull()).select(
            *group, F.floor(F.col("pos") / size).alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
        tables.append(stored(_fold_block(blocks, group, fan_in)))
    tops = tables[-1].where("pos = 0").select(*group, "top")
    above = None
    for table in reversed(tables):
        below = table.drop("top")
        if above is not None:
            upper = stored(above.select(*group, F.col("pos").alias("_block"), F.col("path").alias("_path")))
            below = (attach(below.withColumn("_block", F.floor(F.col("pos") / size)), upper, [*group, "_block"], "inner")
                     .withColumn("path", F.concat("path", "_path")).drop("_block", "_path"))
        above = below
    return above, tops


def _siblings(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def _folded(path: Column, leaf: Column) -> Column:
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, claimed: Column | None = None, fan_in: int = 2) -> DataFrame:
    """``order`` (under its own name), leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``claimed`` is the leaf that a row claims to have, null where it is the right one: the fold starts
    from it, with the siblings of the tree. Other columns of ``rows`` don't take part.
    """
    found = numbered(rows.select(F.col(group).alias("part"), F.col(order).alias("place"), leaf.alias("node"),
                                 (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed")),
                     ["part"], ["place", "node"])
    found = stored(found)
    largest = found.agg(F.max("n")).first()[0] or 0
    leaves, tops = fold(found, ["part"], largest, fan_in)
    tops = stored(numbered(tops.select("part", F.col("top").alias("node")), [], ["part"]))
    n_groups = tops.agg(F.max("n")).first()[0] or 0
    groups, root = fold(tops, [], n_groups, fan_in)
    top = root.first()
    groups = stored(groups.select("part", F.col("node").alias("subroot"), F.col("path").alias("_over")))
    out = attach(leaves, groups, ["part"], "inner").withColumn("path", F.concat("path", "_over"))
    out = out.select(F.col("place").alias(order), F.col("node").alias("leaf"), "subroot",
                     F.lit(top[0] if top else None).cast("string").alias("root"), _siblings(F.col("path")).alias("proof_sha256"),
                     _folded(F.col("path"), F.coalesce("claimed", "node")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` by lang and doc_id; where 7 divides crc32(doc_id) one is added to n_chars.

    A row without doc_id is not tampered with; a null n_chars stays null.
    """
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(changed, leaf_hash(fields | {"n_chars": F.col("n_chars") + 1}))
    return manifest(docs, "lang", "doc_id", leaf_hash(fields), tampered)
