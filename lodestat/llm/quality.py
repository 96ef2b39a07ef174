"""Quality classifier by importance resampling with hashed n-gram models.

Each class of labelled text (wanted, low quality, toxic) has a generative model: the share of its
texts in which a hashed n-gram occurs at a level of frequency. N-grams are words, word beginnings,
word ends, repeats of the word before and words in capitals, and are counted in blocks of at most ``BLOCK``
words that cut a text into equal parts: a text holds an n-gram if one of its blocks does, and the
odds of a class are the mean over the blocks of a text, so the strongest ones decide. A class shares the wanted model wherever it
doesn't hold an n-gram significantly and several times more often. Raw text is the mixture of the
classes at their labelled shares, so the importance weight of a text is p(wanted) / p(raw). Texts are
sampled by Gumbel top-k: ``sharpness`` times the log weight plus a Gumbel value drawn from a hash of
the row, largest first. k is the number of rows whose weight exceeds the bound that tells labelled
texts apart with the fewest errors.

The models are fitted on a bounded sample of labelled texts (``sample``, one of each group of near copies); the
weights, the number to keep and the threshold cover all rows. Null or empty texts have weight one
over the wanted share, as nothing speaks against them. Labels with a null are left out; a doc_id with
several labels counts as bad if one of them says so. Without labels of wanted text all rows stay.
Rows that repeat a doc_id and its text get the same value and are kept or rejected together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.jaccard_join import shingle_sets
from lodestat.llm.repeats import with_keys
from lodestat.llm.text import BYTE_VALUES, LOWER, Fingerprints, buffer, group_starts, mix, slices, word_spans
from lodestat.sources.files import stored

BUCKETS = 1 << 18
#: An n-gram's share of a text's words counts as well, by powers of two down to this one.
LEVELS = 5
#: A bucket counts for a class if its share differs from that of wanted text by so many deviations.
SIGNIFICANT = 6.0
#: ... and its share is so many times larger (as a logarithm).
LARGER = 3.0
#: Longer texts are cut into equal blocks of at most so many words.
BLOCK = 400
#: Log weights are told apart in steps of this size, down to the lowest, when the bound is sought.
STEP, LOWEST = 0.25, -50.0
WANTED, LOW, TOXIC = 0, 1, 2
CAPITAL = np.isin(np.arange(256), np.arange(65, 91))


#: Blocks looked at together, and bytes of text whose words are found together (one longer text excepted).
TOGETHER, FEW_BYTES = 512, 1 << 20


def features(data: np.ndarray, offsets: np.ndarray):
    """For few blocks at a time: the first of them, the buckets of their n-grams, each once in a block, and where each block's begin.

    First come the first block of each text with the number of all, and the words of each text.
    """
    starts, ends, begin = word_spans(data, offsets)
    words = np.diff(begin)
    blocks = np.maximum(1, -(-words // BLOCK))
    first_block = np.append(0, np.cumsum(blocks))
    n = int(first_block[-1])
    of = np.repeat(np.arange(len(words)), blocks)
    of_text = np.append(begin[of] + (np.arange(n) - first_block[of]) * words[of] // blocks[of], begin[-1:])
    heads = begin[:-1][words > 0]  # first words of texts repeat nothing

    def parts():
        for a in range(0, n, TOGETHER):
            b = min(n, a + TOGETHER)
            yield a, *_block_features(data, starts, ends, of_text[a:b + 1], heads)

    return first_block, words, parts()


def _block_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, heads: np.ndarray):
    """Buckets of some blocks' n-grams and where each block's begin; ``begin``: their first words and the end."""
    n, w0, w1 = len(begin) - 1, int(begin[0]), int(begin[-1])
    lead = int(w0 > 0 and w1 > w0)  # the word before the first is looked at as well
    starts, ends = starts[w0 - lead:w1], ends[w0 - lead:w1]
    shift = int(starts[0]) if len(starts) else 0
    data = data[shift:int(ends[-1]) if len(ends) else 0]
    starts, ends = starts - shift, ends - shift
    raw, low = Fingerprints(BYTE_VALUES[data]), Fingerprints(BYTE_VALUES[LOWER[data]])
    whole = low.of(starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = whole[1:] == whole[:-1]
    again = again[lead:]
    again[heads[(heads >= w0) & (heads < w1)] - w0] = False
    whole, starts, ends = whole[lead:], starts[lead:], ends[lead:]
    head = mix(low.of(starts, np.minimum(starts + 5, ends)) + np.uint64(1))
    tail = mix(raw.of(np.maximum(ends - 2, starts), ends) + np.uint64(2))
    capitals = np.append(0, np.cumsum(CAPITAL[data]))
    shout = (capitals[ends] - capitals[starts]) >= 2
    flags = mix(again.astype(np.uint64) + np.uint64(2) * shout.astype(np.uint64) + np.uint64(1000))
    each = np.stack([whole, head, tail, flags], axis=1).reshape(-1)
    at = 4 * (begin - w0)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        each[a:b].sort()
    block = np.repeat(np.arange(n), np.diff(at))
    first = group_starts(block, each)
    count = np.diff(np.append(first, len(each)))
    block, each = block[first], each[first]
    level = np.floor(np.log2(np.diff(begin)[block] / count))
    often = level < LEVELS
    block = np.append(block, block[often])
    each = np.append(mix(each), mix(each[often] + np.uint64(1) + np.maximum(level[often], 0).astype(np.uint64)))
    order = np.argsort(block, kind="stable")
    return (each[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(block[order], np.arange(n + 1))


def _sampled(batches):
    """Labelled texts with the smallest fingerprint of their five-word shingles, which near copies mostly share."""
    for batch in batches:
        data, offsets = buffer(batch.column("text"))
        h, at = shingle_sets(data, offsets, 5)
        least = np.append(h, np.uint64(0))[np.where(np.diff(at) > 0, at[:-1], len(h))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], [*batch.schema.names, "least"])


def _counted(batches):
    """Texts of each class in which a bucket occurs; bucket -1: texts of the class."""
    total = np.zeros((3, BUCKETS + 1), np.int64)
    for batch in batches:
        data, offsets = buffer(batch.column("text"))
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, FEW_BYTES):
            first_block, _, parts = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            of = np.repeat(np.arange(b - a), np.diff(first_block))
            open_text, open_buckets = -1, np.zeros(0, np.int64)  # the text that goes on in the next part
            for first, bucket, at in parts:
                text = np.repeat(of[first:first + len(at) - 1], np.diff(at))
                once = np.unique(text * BUCKETS + bucket)
                text, bucket = once // BUCKETS, once % BUCKETS
                bucket_new = ~((text == open_text) & np.isin(bucket, open_buckets))
                np.add.at(total, (kind[a + text[bucket_new]], bucket[bucket_new]), 1)
                last = of[first + len(at) - 2]
                held = bucket[text == last]
                open_buckets = np.union1d(open_buckets, held) if last == open_text else held
                open_text = last
            np.add.at(total[:, BUCKETS], kind[a:b], 1)
    k, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(np.where(bucket == BUCKETS, -1, bucket), pa.int32()), pa.array(total[k, bucket])],
                                     ["kind", "bucket", "n"])


def fit(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Log ratio of the two unwanted classes to wanted text by bucket, the classes' shares, and the sampled labels."""
    sound = labels.where("doc_id is not null and quality is not null and toxic is not null")
    kind = F.when(F.max("toxic") > 0, TOXIC).when(F.min("quality") < 1, LOW).otherwise(WANTED)
    chosen = stored(sound.groupBy("doc_id").agg(kind.alias("kind")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    texts = texts.select("text", "kind").mapInArrow(_sampled, "text string, kind int, least long").dropDuplicates(["least", "kind"])
    of_class = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (WANTED, LOW, TOXIC)]
    found = stored(texts.select("text", "kind").mapInArrow(_counted, "kind int, bucket int, n long").groupBy("bucket").agg(*of_class))
    whole = found.where("bucket = -1").first()
    texts_of = np.array([float(whole[f"n{k}"]) for k in (WANTED, LOW, TOXIC)]) if whole else np.zeros(3)
    counts = np.zeros((3, BUCKETS))
    # only buckets come to the driver that a class holds almost significantly more often
    told = F.lit(False)
    for k in (LOW, TOXIC):
        if texts_of[k] and texts_of[WANTED]:
            n, m = F.col(f"n{k}"), F.col(f"n{WANTED}")
            both = (n + m) / float(texts_of[k] + texts_of[WANTED])
            spread = F.sqrt(both * (1 - both) * float(1 / texts_of[k] + 1 / texts_of[WANTED]))
            told = told | (n / float(texts_of[k]) - m / float(texts_of[WANTED]) >= 0.99 * SIGNIFICANT * spread)
    for r in found.where((F.col("bucket") >= 0) & told).collect():  # at most BUCKETS rows
        counts[:, r["bucket"]] = r["n0"], r["n1"], r["n2"]
    share = texts_of / max(1.0, texts_of.sum())
    ratio = np.zeros((2, BUCKETS))
    for k in (LOW, TOXIC):
        if texts_of[k] and texts_of[WANTED]:
            both = (counts[k] + counts[WANTED]) / (texts_of[k] + texts_of[WANTED])
            spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / texts_of[k] + 1 / texts_of[WANTED]))
            p, q = (counts[k] + 0.5) / (texts_of[k] + 1), (counts[WANTED] + 0.5) / (texts_of[WANTED] + 1)
            differs = counts[k] / texts_of[k] - counts[WANTED] / texts_of[WANTED] > SIGNIFICANT * spread
            ratio[k - 1] = np.where(differs & (np.log(p / q) > LARGER), np.log(p / q), 0)
    return ratio, share, chosen


def _weighed(ratio: np.ndarray, share: np.ndarray):
    def build(batches):
        with np.errstate(divide="ignore"):
            prior = np.log(share / share[WANTED]) if share[WANTED] else np.full(3, -np.inf)
        for batch in batches:
            data, offsets = buffer(batch.column("text"))
            out = [np.zeros(0)]
            for a, b in slices(offsets, FEW_BYTES):
                first_block, words, parts = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                evidence = np.zeros((2, int(first_block[-1])))
                for first, bucket, at in parts:
                    for k in (LOW, TOXIC):
                        total = np.append(0, np.cumsum(ratio[k - 1][bucket]))
                        evidence[k - 1, first:first + len(at) - 1] = total[at[1:]] - total[at[:-1]]
                odds = []
                for k in (LOW, TOXIC):
                    mean = np.logaddexp.reduceat(evidence[k - 1], first_block[:-1]) - np.log(np.diff(first_block))
                    odds.append(prior[k] + np.where(words > 0, mean, np.minimum(0, -5 - prior[k])))
                out.append(-np.logaddexp(0, np.logaddexp(*odds)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_doc"), batch.column("_row"), pa.array(np.concatenate(out))],
                                             ["doc_id", "_doc", "_row", "log_weight"])
    return build


def kth_largest(values: DataFrame, column: str, k: int, collect: int = 10_000) -> float:
    """The k-th largest value of a column, by histograms that narrow to few values."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = values.where(F.col(column).between(low, high)).select(F.col(column).alias("v"))
        width = (high - low) / 1000
        if width <= 0 or low + width == low:
            return low
        bins = {r["bin"]: r for r in inside.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(999)).alias("bin"))
                .agg(F.count("*").alias("n"), F.min("v").alias("x"), F.max("v").alias("y")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                break
            above += bins[b]["n"]
        low, high = bins[b]["x"], bins[b]["y"]
        if low == high:
            return low
        if bins[b]["n"] <= collect:
            rest = sorted((r["v"] for r in inside.where(F.col("v").between(low, high)).collect()), reverse=True)
            return rest[k - above - 1]


def bound(scored: DataFrame, chosen: DataFrame) -> float:
    """The log weight that tells the sampled labels apart with the fewest errors."""
    step = F.floor(F.greatest("log_weight", F.lit(LOWEST)) / STEP).cast("int")
    found = scored.join(F.broadcast(chosen), "doc_id").groupBy(step.alias("step"), (F.col("kind") == WANTED).alias("wanted")).count().collect()
    steps = np.arange(int(LOWEST / STEP), 1)
    good, bad = np.zeros(len(steps)), np.zeros(len(steps))
    for r in found:
        (good if r["wanted"] else bad)[r["step"] - steps[0]] += r["count"]
    errors = np.cumsum(good) - good + np.cumsum(bad[::-1])[::-1]  # good ones below the step, bad ones from it on
    return float(steps[len(steps) - 1 - np.argmin(errors[::-1])] * STEP)


def resample(docs: DataFrame, labels: DataFrame, sample: int = 20_000, sharpness: float = 8.0, seed: int = 7) -> DataFrame:
    """doc_id, row keys, log_weight (of wanted against raw, up to a constant), and whether the row is kept."""
    ratio, share, chosen = fit(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = with_keys(docs).mapInArrow(_weighed(ratio, share), f"doc_id {kind}, _doc long, _row long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_doc", "_row"), 11).cast("double") + 0.5) / float(2**53)
    scored = stored(weighed.withColumn("value", sharpness * F.col("log_weight") - F.log(-F.log(u))))
    if not share[WANTED]:
        return scored.withColumn("kept", F.lit(True))
    k = scored.where(F.col("log_weight") >= bound(scored, chosen)).count()
    return scored.withColumn("kept", F.col("value") >= kth_largest(scored, "value", k) if k else F.lit(False))
