"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut at blanks into words with their blank signs, which no piece crosses. A slice's different
words are concatenated and indexed by a suffix array over as many bytes as the longest piece has;
every piece is looked up in it by binary search, which gives its occurrence ranges. The occurrences
are edges; sorted by their ends they are relaxed from left to right. The pieces were made by merges:
a sequence of pieces is the merge order's result exactly if every two neighbours, merged anew, give
themselves. So an edge extends a prefix only if its last piece and the edge's do, each prefix has one
last piece, and the path found is the tokenizer's. Characters without a piece become byte pieces.
Decoding joins the pieces, turns byte pieces into bytes and blank signs into blanks.

A null text has null ids, the empty text none. Rows that repeat a doc_id are encoded each. A text that
holds the blank sign itself decodes to a blank there.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestat.llm.text import buffer, group_starts, slices

BLANK = "▁"
WORD = re.compile(f"{BLANK}+[^{BLANK}]*")
#: Entries of a task's tables of words and pairs; beyond that they start anew.
TABLE = 500_000
#: Bits of a slot number, and the odd factor that spreads pairs over the slots.
CACHE, SPREAD = 20, np.int64(0x1E3779B97F4A7C15)
FREE, START = -9, -2
#: Bytes of a character by the upper half of its first byte.
CHAR_WIDTH = np.array([1] * 12 + [2, 2, 3, 4])
#: Between words: a byte that no UTF-8 text has.
BETWEEN = b"\xff"


def _in_order(suffix: np.ndarray) -> np.ndarray:
    """The suffixes' order: by the first eight bytes as a number, then those that are alike in these."""
    width = suffix.dtype.itemsize
    if width < 8:
        return np.argsort(suffix, kind="stable")
    head = np.ascontiguousarray(suffix.view(np.uint8).reshape(-1, width)[:, :8]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(head, kind="stable")
    head = head[order]
    alike = np.zeros(len(head), bool)
    alike[1:] = head[1:] == head[:-1]
    alike[:-1] |= alike[1:]
    at = np.flatnonzero(alike)
    order[at] = order[at][np.argsort(suffix[order[at]], kind="stable")]
    return order


class Matcher:
    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.texts[i]: model.get_score(i) for i in plain}
        self.ids = {self.texts[i]: i for i in plain}
        self.byte = {int(self.texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes = [t.encode() for t in self.texts]
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.byte_ids = np.array([self.byte[b] for b in range(256)])
        # long pieces first, so that edges come in that order
        self.pieces = sorted(((self.texts[i].encode(), i) for i in plain), key=lambda p: (-len(p[0]), p[0]))
        self.width = len(self.pieces[0][0])
        kind = f"S{self.width}"
        self.low = np.array([p for p, _ in self.pieces], kind)
        self.high = np.array([p + b"\xff" * (self.width - len(p)) for p, _ in self.pieces], kind)
        self.sizes, self.numbers = np.array([len(p) for p, _ in self.pieces]), np.array([i for _, i in self.pieces])
        self.words: dict[str, tuple[int, ...]] = {}
        #: Pairs of neighbours looked at so far, and whether they stay.
        self.pairs, self.stays = np.zeros(0, np.int64), np.zeros(0, bool)
        #: Some of them by slot, as most lookups are of few pairs.
        self.near, self.near_stays = np.full(1 << CACHE, -1), np.zeros(1 << CACHE, bool)

    def _stays(self, a: int, b: int) -> bool:
        """Whether two neighbouring pieces, merged anew, give themselves."""
        x, y = self.texts[a], self.texts[b]
        score = self.score
        if not any(x[i:] + y[:j] in score for i in range(len(x)) for j in range(1, len(y) + 1)):
            return True  # no piece crosses the border
        parts = list(x + y)
        border = len(x)
        while len(parts) > 1:
            best, at, place, i = -np.inf, -1, 0, 0
            for i in range(len(parts) - 1):
                value = score.get(parts[i] + parts[i + 1], -np.inf)
                if value > best:
                    best, at = value, i
            if at < 0:
                break
            place = sum(map(len, parts[:at + 1]))
            if place == border:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts == [x, y]

    def _all_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stays`` of many pairs, each different one worked out once."""
        keys = a * len(self.texts) + b
        slot = (keys * SPREAD & (2**63 - 1)) >> (63 - CACHE)
        out = self.near_stays[slot]
        far = np.flatnonzero(self.near[slot] != keys)
        if not len(far):
            return out
        keys, of = np.unique(keys[far], return_inverse=True)
        place = np.searchsorted(self.pairs, keys)
        known = np.append(self.pairs, -1)[place] == keys
        new = keys[~known]
        if len(new):
            fresh = [self._stays(*divmod(k, len(self.texts))) for k in new.tolist()]
            self.pairs, self.stays = np.insert(self.pairs, place[~known], new), np.insert(self.stays, place[~known], fresh)
            place = np.searchsorted(self.pairs, keys)
        out[far] = self.stays[place][of]
        slot = slot[far]
        slot, one = np.unique(slot, return_index=True)  # one pair for each slot
        self.near[slot], self.near_stays[slot] = keys[of[one]], out[far[one]]
        return out

    def _match(self, words: list[str]) -> None:
        """Encodes new words."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(BETWEEN.join(raw) + BETWEEN * (self.width + 1), np.uint8)
        suffix = np.lib.stride_tricks.sliding_window_view(data, self.width).copy().view(f"S{self.width}").ravel()
        order = _in_order(suffix)
        suffix = suffix[order]
        low, high = np.searchsorted(suffix, self.low), np.searchsorted(suffix, self.high, side="right")
        n = high - low
        start = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        size, piece = np.repeat(self.sizes, n), np.repeat(self.numbers, n)
        # characters without a piece
        lead = (data != BETWEEN[0]) & (data & 0xC0 != 0x80)
        whole = lead[start] & (size == CHAR_WIDTH[data[start] >> 4])
        lead[start[whole]] = False
        alone = np.flatnonzero(lead)
        start, end, piece = np.append(start, alone), np.append(start + size, alone + CHAR_WIDTH[data[alone] >> 4]), np.append(piece, np.full(len(alone), -1))
        begins = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
        reach = end - np.repeat(begins[:-1], np.diff(begins))[start]  # of the edge's end in its word
        # those of one end stay in order of size, the longest first
        order = np.argsort(reach.astype(np.min_scalar_type(int(reach.max(initial=0)))), kind="stable")
        start, end, piece, reach = start[order], end[order], piece[order], reach[order]
        # all words at once, one end after the other; FREE: not reached, START: nothing before
        last, came = np.full(len(data) + 1, FREE), np.zeros(len(data) + 1, np.int64)
        last[begins[:-1]] = START
        at = group_starts(reach)
        for i, j in zip(at.tolist(), np.append(at[1:], len(reach)).tolist(), strict=True):
            s, e, p = start[i:j], end[i:j], piece[i:j]
            before = last[s]
            ok = before != FREE
            test = np.flatnonzero(ok & (before >= 0) & (p >= 0))
            ok[test] = self._all_stay(before[test], p[test])
            s, e, p = s[ok][::-1], e[ok][::-1], p[ok][::-1]  # the longest piece of several is written last
            last[e], came[e] = p, s
        # back from the ends of all words, a piece of each at a time
        word, at, steps = np.arange(len(words)), begins[1:] - 1, []
        while len(word):
            steps.append((word, came[at], at, last[at]))
            at = came[at]
            going = at > begins[word]
            word, at = word[going], at[going]
        word, start, end, piece = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
        order = np.argsort(word, kind="stable")
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        n = np.where(piece >= 0, 1, end - start)  # a character without a piece gives its bytes
        place = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        piece = np.repeat(piece, n)
        ids = tuple(np.where(piece >= 0, piece, self.byte_ids[data[place]]).tolist())
        ends = np.cumsum(np.bincount(word, n, len(words)).astype(np.int64)).tolist()
        self.words.update(zip(words, (ids[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        if len(self.words) > TABLE:
            self.words.clear()
        if len(self.pairs) > TABLE:
            self.pairs, self.stays = self.pairs[:0], self.stays[:0]
        cut = [None if t is None else WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = list(set().union(*filter(None, cut)).difference(self.words))
        if new:
            self._match(new)
        return [None if c is None else list(chain.from_iterable(map(self.words.__getitem__, c))) for c in cut]

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def _matcher(path: str) -> Matcher:
    """The process's own, with its tables of words and pairs, as a Python worker runs many tasks."""
    return Matcher(path)


def _encoded(path: str):
    def build(batches):
        matcher = _matcher(path)
        for batch in batches:
            _, offsets = buffer(batch.column("text"))
            for a, b in slices(offsets, 2 << 20):
                texts = batch.column("text")[a:b].to_pylist()
                ids = matcher.encode(texts)
                same = [None if t is None else matcher.decode(i) == t for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                                                 ["doc_id", "ids", "decodes"])
    return build


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, piece ids, and whether they decode to the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoded(model), f"doc_id {kind}, ids array<int>, decodes boolean")
