"""Document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words (A-Z lower-cased; a text of one word is one term), weighted by
how often they occur. For each of ``SAMPLES`` samples every term has gamma-distributed values r and c
and a uniform value beta, hashed from its whole 64-bit fingerprint; the term of the smallest derived
value, with its level t, is the sample. Two samples agree with the probability of the generalised
Jaccard similarity of the weights. As r = v + e and c = x + y are sums of exponential values with
v = -log(x / c) and beta = e / r, a term of weight w has the level t = floor((log w + e) / r) and the
value x * exp(-r * t); at level 0 that is x alone, so the other draws are made for repeated terms only.

Null or empty texts and texts without words have the same fingerprint. The next document is the next
row in order of doc_id (nulls first, then a hash of the text), after the last the first; a single row
is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.repeats import with_keys
from lodestat.llm.text import Fingerprints, group_starts, mix, slices, word_values

SAMPLES, SEED = 64, 11
#: Bytes of text whose samples are drawn at once.
AT_ONCE = 1 << 20
#: Terms hashed at once.
TERMS_AT_ONCE = 1 << 13


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Sampler:
    def __init__(self):
        self.salt = np.random.default_rng(SEED).integers(1, 2**64, (3, SAMPLES), dtype=np.uint64)

    def _least(self, term: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The smallest hash of each text's terms for each sample."""
        cuts = np.arange(0, len(term), TERMS_AT_ONCE)
        piece = np.union1d(start, cuts)
        at = np.append(np.searchsorted(piece, cuts), len(piece))
        out = np.empty((SAMPLES, len(piece)), np.uint64)
        for k, a in enumerate(cuts.tolist()):
            some, begin = term[a:a + TERMS_AT_ONCE], piece[at[k]:at[k + 1]] - a
            for s in range(SAMPLES):
                out[s, at[k]:at[k + 1]] = np.minimum.reduceat(mix(some + self.salt[0, s]), begin)
        return np.minimum.reduceat(out, np.searchsorted(piece, start), axis=1)

    def _samples(self, term: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Sixteen bits of the chosen term and level of each text, for each sample."""
        least = self._least(term, start)
        level = np.zeros(least.shape, np.int64)
        more = np.flatnonzero(weight > 1)
        if len(more):
            term, of, log = term[more], np.searchsorted(start, more, side="right") - 1, np.log(weight[more])
            begin = group_starts(of)
            size = np.diff(np.append(begin, len(of)))
            for s in range(SAMPLES):
                h = mix(term + self.salt[0, s])
                x, e, y = -np.log1p(-_uniform(h)), *(-np.log(_uniform(mix(term + self.salt[i, s]))) for i in (1, 2))
                r = e - np.log(x / (x + y))
                t = np.floor((log + e) / r)
                value = x * np.exp(-r * t)
                best = np.minimum(np.minimum.reduceat(value, begin), -np.log1p(-_uniform(least[s, of[begin]])))
                won = np.flatnonzero((t > 0) & (value == np.repeat(best, size)))
                least[s, of[won]], level[s, of[won]] = h[won], t[won].astype(np.int64)
        return mix(least ^ mix(level)) >> np.uint64(48)

    def signatures(self, texts: list[str]) -> np.ndarray:
        """Sixteen bits of each sample of each text."""
        raw = [t.encode() for t in texts]
        offsets = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        out = np.zeros((len(texts), SAMPLES), "<u2")
        for a, b in slices(offsets, AT_ONCE):
            values, _, _, begin = word_values(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lower=True)
            words = np.diff(begin)
            count = np.where(words >= 2, words - 1, words)
            at = np.append(0, np.cumsum(count))
            first = np.repeat(begin[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
            h = Fingerprints(values).of(first, first + np.repeat(np.minimum(words, 2), count))
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                h[i:j].sort()
            text = np.repeat(np.arange(b - a), count)
            new = group_starts(text, h)
            weight = np.diff(np.append(new, len(h)))
            text, term = text[new], h[new]
            if not len(term):
                continue
            start = group_starts(text)
            out[a + text[start]] = self._samples(term, weight, start).T
        return out


def _printed(batches):
    sampler, pending = Sampler(), None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")), strict=True))
        if pending is not None:
            rows.insert(0, pending)
        if not rows:
            continue
        pending = rows[-1]
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        texts = [r[3] or "" for r in rows]
        sizes = [len(texts[i]) for i, _ in pairs]
        edited = [texts[i][:n - n // 4] + texts[j][:n // 4] for (i, j), n in zip(pairs, sizes, strict=True)]
        own, other = sampler.signatures(texts), sampler.signatures(edited)
        mine, following = (own[[p[k] for p in pairs]] for k in (0, 1))
        near = [(mine == x).mean(axis=1) if len(pairs) else np.zeros(0) for x in (other, following)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i, _ in pairs], batch.schema.field("doc_id").type), pa.array(sizes, pa.int64()),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
             pa.array([x.tobytes().hex() for x in mine], pa.string()), pa.array([x.tobytes().hex() for x in other], pa.string()), *map(pa.array, near)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter from the next document)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_keys(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = keyed.agg(F.percentile_approx("_doc", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [] if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("_doc"))) if cuts else F.lit(0)
    keyed = keyed.withColumn("part", part)
    heads = {r["part"]: r["head"] for r in keyed.groupBy("part").agg(F.min(F.struct("_doc", "_row")).alias("head")).collect()}  # one row a part
    order = sorted(heads)
    before = F.lit(None).cast("int")
    for i, p in enumerate(order):  # the first row of a part also follows the last row of the part before
        head = heads[p]
        before = F.when((F.col("part") == p) & (F.col("_doc") == F.lit(head["_doc"])) & (F.col("_row") == F.lit(head["_row"])), order[i - 1]).otherwise(before)
    place = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(before.alias("part"), F.lit(True).alias("ghost"))
    spread = keyed.withColumn("at", F.explode(F.filter(F.array(place, ghost), lambda x: x["part"].isNotNull())))
    return (spread.select("at.part", "at.ghost", "_doc", "_row", "doc_id", "text").repartition(parts, "part")
            .sortWithinPartitions("part", "ghost", "_doc", "_row").select("part", "ghost", "doc_id", "text")
            .mapInArrow(_printed, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
