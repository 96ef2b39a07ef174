"""The pipeline against plain computations: each stage on what its predecessor kept, and the whole run."""

import random
import re
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = {i: text(60) + (" scum idiot scum" if i % 4 == 0 else "") for i in range(400)}
    for i in range(400, 410):
        texts[i] = f"edit{i} " + texts[1].split(" ", 1)[1]
    passage = text(30)
    texts |= {410: texts[2], 411: texts[2]}
    texts |= {i: f"{text(40)} {passage}\n{text(40)}" for i in range(412, 415)}
    texts |= {415: text(40) + " mail a.b@mail1.example.com today", 416: None, 417: "", 418: "one", 419: text(3000), 420: None}
    return texts


def near_groups(texts):
    """Smallest document of each group linked by five-word shingles."""
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").lower())
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if least[a] != least[b] and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return set(least.values())


def without_repeats(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        w = WORD.findall(texts[d] or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i:i + 20])
            if k in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(k)
        out[d] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def test_pipeline(spark, tmp_path):
    texts = corpus()
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert kept.columns == docs.columns
            docs = kept
            found = docs.collect()
            after.append({r.doc_id: r.text for r in found})
            assert len(after[-1]) == len(found) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    classified, single, cut, hidden = after

    assert classified == {d: t for d, t in texts.items() if "scum" not in (t or "")}
    assert single == {d: classified[d] for d in near_groups(classified)}
    want = without_repeats(single)
    assert {d: WORD.findall(t or "") for d, t in cut.items()} == want
    assert sum(len(want[d]) for d in (412, 413, 414)) == 3 * 80 + 30

    assert {d: t for d, t in hidden.items() if d != 415} == {d: t for d, t in cut.items() if d != 415}
    before, now = cut[415].split(), hidden[415].split()
    assert len(before) == len(now) and [x == y for x, y in zip(before, now, strict=True)].count(False) == 1
    assert "a.b@mail1" not in hidden[415] and re.search(r"mail \S+@\S+\.com today$", hidden[415])

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = set()
    for d, t in hidden.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, stop in enumerate(range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)):
            part = ids[at:stop]
            pieces.add((d, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
            at = stop
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(packed) == len(pieces) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed} == pieces
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
