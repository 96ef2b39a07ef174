"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit. Pieces are sorted by length and ranked within their length by distributed
counts; gaps (open sequences) are kept in runs of equal room. A round takes the longest lengths left:
its sweep finds for each the successor among the gaps, the smallest that holds it; pieces that want
the same gap are told apart by rank, the gaps shrink, and the next round follows. Pieces of equal
length and gaps of equal room are interchangeable, so the sweeps work on runs: one row for each
length (at most ``capacity`` of them, whatever the input) goes to the driver, never a row for each
document. The result equals best-fit decreasing.

Null or empty texts are documents of one token, the end id. Rows that repeat a doc_id are packed
each; a null doc_id stays null. Texts of any length are cut into pieces of ``capacity`` tokens, the
first of which may be shorter.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.text import buffer, slices
from lodestat.sources.files import stored

#: Entries of a task's table of tokenised words; beyond that it starts anew.
WORD_TABLE = 800_000
#: A blank between two white characters isn't a border of tokens.
INNER_BLANK = re.compile(r" \s(?<=\s \s)")

PIECES = "doc_id {id}, piece int, start long, length int, ids_crc32 long"


class WordTable:
    """Token ids of texts, by way of the ids of their words.

    The byte-level pattern always begins a token at a blank unless it stands between two white
    characters, and merges never cross tokens; so the ids of a text are those of its parts cut before
    each blank, put together. Texts with a blank between white characters, or with a special token's
    bracket, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens_word[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte-level sign of a blank

    def _encode(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        if len(self.words) > WORD_TABLE:
            self.words.clear()
        parts: list[list[str] | None] = []
        for t in texts:
            parts.append(None if "<|" in t or INNER_BLANK.search(t) else t.split(" "))
        heads = self._encode([p[0] if p else t for p, t in zip(parts, texts, strict=True)])
        new = {w for p in parts if p for w in p[1:]}.difference(self.words)
        plain = [w for w in new if w and w.isprintable()]  # no white space within
        if plain:  # as one text: a token with a blank begins a word
            ids = self._encode([" " + " ".join(plain)])[0]
            at = 4 * np.append(np.flatnonzero(self.opens_word[np.frombuffer(ids, "<u4")]), len(ids) // 4)
            self.words.update(zip(plain, (ids[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), strict=True))
        new = list(new.difference(plain))
        self.words.update(zip(new, self._encode([" " + w for w in new]), strict=True))
        get = self.words.__getitem__
        return [h + b"".join(map(get, p[1:])) if p else h for p, h in zip(parts, heads, strict=True)]


def _tokenised(path: str, capacity: int, end: bytes):
    def build(batches):
        table = WordTable(path)
        for batch in batches:
            _, offsets = buffer(batch.column("text"))
            for a, b in slices(offsets):
                doc, piece, start, length, crc = [], [], [], [], []
                texts = [t or "" for t in batch.column("text")[a:b].to_pylist()]
                ids = batch.column("doc_id")[a:b].to_pylist()
                for d, got in zip(ids, table.encode(texts), strict=True):
                    got += end
                    n = len(got) // 4
                    at = 0
                    for k, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        doc.append(d)
                        piece.append(k)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(got[4 * at:4 * stop]))
                        at = stop
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int32()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return build


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    return docs.select("doc_id", "text").mapInArrow(_tokenised(tokenizer, capacity, end), PIECES.format(id=kind))


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, first sequence, first offset): where pieces of a length go.

    A row holds from its first rank up to the next row's of that length; the piece of rank r goes to
    sequence ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # room: runs of sequences
    rooms: list[int] = []
    opened, out = 0, []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = min(room // length, left)
            full = min(n, left // per)
            out.append((length, rank, per, first, capacity - room))
            add(room - per * length, first, full)
            add(room, first + full, n - full)
            left, rank = left - full * per, rank + full * per
    return np.array(out, np.int64).reshape(-1, 5)


def _placed(rows: np.ndarray):
    def build(batches):
        key = rows[:, 0] << np.int64(44) | rows[:, 1]
        order = np.argsort(key)
        key, plan = key[order], rows[order]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            _, first_rank, per, first, offset = plan[np.searchsorted(key, length << np.int64(44) | rank, side="right") - 1].T
            j = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start")), pa.array(length), batch.column("ids_crc32"),
                 pa.array(first + j // per), pa.array(offset + j % per * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return build


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with the sequence and the offset each goes to."""
    spark = found.sparkSession
    kind = found.schema["doc_id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    counts = stored(found.groupBy("length", "_bucket").agg(F.count("*").alias("n")))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (found.withColumn("_within", within).join(before, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_within") - 1))
    return ranked.mapInArrow(_placed(best_fit(lengths, capacity)),
                             f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
