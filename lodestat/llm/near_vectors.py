"""Near-duplicate vectors: exact metric range join by pivots.

Vectors are scaled to length one, where a cosine bound is a bound ``r`` on distance. Each vector's
home is the cell of its nearest pivot. It also goes to the cell of another pivot unless the triangle
inequality, or the distance to the plane between both pivots, shows that no vector at home there
lies within ``r``. Each cell then joins its home vectors with all its vectors, on its own; a large
cell is cut into tiles of bounded size, so a hot cell is many tasks. Equal vectors are one class
from the start, and a tile returns counts and a spanning forest, never its pairs.

Vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing, and
so do vectors of different lengths. Rows that repeat a vec_id are compared like others; a null vec_id
counts as a link but never names a component of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.components import components
from lodestat.sources.files import stored

#: Vectors to a pivot; pivots at most, which bounds what is sent to every task.
PER_PIVOT, MOST_PIVOTS = 16_384, 256
#: Home vectors and other vectors in a tile.
HOME_TILE, OTHER_TILE = 4_096, 16_384
#: Room for rounding in bounds that only decide where vectors are compared.
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    """Unit vectors of equal length as rows."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches):
    for batch in batches:
        v = batch.column("v")
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(pa.compute.list_value_length(v).to_numpy(zero_copy_only=False))
        blobs = [flat[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(blobs, pa.binary())], ["id", "n", "v"])


def _assigned(pivots: dict[int, np.ndarray], r: float):
    def build(batches):
        for batch in batches:
            width = np.array([len(x) for x in batch.column("v").to_pylist()])
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                x = _matrix(part.column("v"))
                p = pivots.get(int(w))
                if p is None:
                    row, cell, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                else:
                    dot = x @ p.T
                    home = dot.argmax(axis=1)
                    best = dot[np.arange(len(x)), home][:, None]
                    apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                    far = lambda d: np.sqrt(np.maximum(0, 2 - 2 * d))
                    goes = (best - dot <= r * apart + SLACK) & (far(dot) <= far(best) + 2 * r + SLACK)
                    goes[np.arange(len(x)), home] = True
                    row, cell = np.nonzero(goes)
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array((np.int64(w) << 16) + cell), pa.array(cell == home[row])], ["id", "n", "v", "cell", "home"])
    return build


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _tile(cosine: float):
    def build(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        h, o = np.flatnonzero(own), np.flatnonzero(~own)
        links = np.zeros(len(h), np.int64)
        uniq, node = np.unique(ids, return_inverse=True)
        fa, fb = np.zeros(0, np.int64), np.zeros(0, np.int64)
        others = x[o].T
        for i in range(0, len(h), 256):
            near = x[h[i:i + 256]] @ others >= cosine
            a, b = np.nonzero(near)
            links[i:i + 256] = np.bincount(a, n[o[b]], len(near)).astype(np.int64)
            label = local_forest(len(uniq), np.append(fa, node[h[i + a]]), np.append(fb, node[o[b]]))
            fa = np.flatnonzero(label != np.arange(len(uniq)))
            fb = label[fa]
        return pa.table({"id": np.append(ids[h], uniq[fa]), "n": pa.array(np.append(links, np.zeros(len(fa), np.int64))),
                         "other": pa.concat_arrays([pa.nulls(len(h), pa.int64()), pa.array(uniq[fb])])})
    return build


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding)."""
    v = F.col("embedding").cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), v).alias("v")).withColumn(
        "id", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("check", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    classes = stored(rows.where("v is not null").groupBy("id", "check").agg(F.first("v").alias("v"), F.count("*").alias("n"))
                     .select("id", "n", "v").mapInArrow(_packed, "id long, n long, v binary"))
    r = math.sqrt(2 - 2 * cosine)
    wanted = min(MOST_PIVOTS, -(-classes.count() // PER_PIVOT))
    pivots: dict[int, list[np.ndarray]] = {}
    for p in classes.orderBy(F.xxhash64(F.lit(2), "id")).limit(wanted).collect():
        pivots.setdefault(len(p["v"]), []).append(np.frombuffer(p["v"]) / np.linalg.norm(np.frombuffer(p["v"])))
    cells = stored(classes.mapInArrow(_assigned({k: np.stack(x) for k, x in pivots.items()}, r), "id long, n long, v binary, cell long, home boolean"))
    size = stored(cells.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / HOME_TILE).alias("homes"),
                                            F.ceil(F.count("*") / OTHER_TILE).alias("others")))
    cells = cells.join(size, "cell").where("homes > 0")
    spot = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    tiles = (cells.where("home").select("id", "n", "v", "cell", F.lit(True).alias("own"), spot(3, "homes").alias("i"), each("others").alias("j"))
             .union(cells.select("id", "n", "v", "cell", F.lit(False).alias("own"), each("homes").alias("i"), spot(4, "others").alias("j"))))
    found = stored(tiles.groupBy("cell", "i", "j").applyInArrow(_tile(cosine), "id long, n long, other long"))
    labels = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counted = (found.where("other is null").groupBy("id").agg((F.sum("n") - 1).alias("n_links"))
               .join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")))
    rows = rows.select("vec_id", "id").join(counted, "id", "left")
    least = stored(rows.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("least")))
    return (rows.join(least, "label", "left").withColumn("component_id", F.coalesce("least", "vec_id").cast("long"))
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))
