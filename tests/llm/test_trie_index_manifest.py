"""Prefix trie, positional index and hash tree against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestat.llm import contamination, manifest, positions, prefix_trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- positions ----------------------------------------------------------------------------------

def test_numbered(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3])) for _ in range(500)]
    got = positions.numbered(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], ["v"]).collect()
    for g in (None, "a", "b"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        values = [(r.v is not None, r.v or 0) for r in own]
        assert values == sorted(values)


# --- prefix trie --------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, d long, rep string"


def trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    for turns in convs.values():
        turns.sort()
    nodes = {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        turns = [t[3:] for t in convs.get(c - c % 5, [])[:h] + convs[c][h:]]
        for d in range(len(turns) + 1):
            key = tuple(turns[:d])
            node = nodes.setdefault(key, {"conv": c, "n": 0, "ends": [], "kids": 0, "leaves": 0, "saved": 0})
            node["n"] += 1
        nodes[tuple(turns)]["ends"].append(str(c))
    for key in sorted(nodes, key=len, reverse=True):
        node = nodes[key]
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (node["n"] - 1) * len(key[-1][1].encode()) if key else 0
        if key:
            above = nodes[key[:-1]]
            above["kids"] += 1
            above["leaves"] += node["leaves"]
            above["saved"] += node["saved"]
    return {(n["conv"], len(k), nodes[k[:-1]]["conv"] if k else None, n["n"], n["kids"], n["leaves"], n["saved"], sha(",".join(n["ends"])))
            for k, n in nodes.items()}


def conversations():
    rng = random.Random(8)
    turns = [("user", "hello"), ("assistant", "hé"), (None, None), ("", ""), ("user", "x" * 300)]
    rows = []
    for c in range(60):
        start = [turns[0], turns[1]] * (c % 3)
        own = [rng.choice(turns) for _ in range(rng.choice([1, 2, 5, 9]))]
        rows += [(c, i, *t) for i, t in enumerate(start + own)]
    long = [rng.choice(turns) for _ in range(90)]
    for c in (100, 101, 105, 110, 111):  # long ones that part late, and at each power of two
        cut = {100: 90, 101: 64, 105: 33, 110: 90, 111: 16}[c]
        rows += [(c, i, *t) for i, t in enumerate(long[:cut] + [("user", str(c))] * (90 - cut))]
    rows += [(207, None, "user", "no turn"), (207, 0, "user", "b"), (207, 0, "user", "a"), (207, 0, "user", "a"), (None, 0, "user", "nobody's")]
    return rows + [(c, 0, "user", "only") for c in range(300, 340)]


def test_prefix_trie(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], TURNS).repartition(3)
    got = prefix_trie.trie(df).collect()
    assert {tuple(r) for r in got} == trie(rows) and len(got) == len(trie(rows))
    none = prefix_trie.trie(spark.createDataFrame([], TURNS))
    assert none.collect() == [] and none.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # conversation c - c % 5 is absent
    rows = [(c, 0, "user", "taken away")]
    assert {tuple(r) for r in prefix_trie.trie(spark.createDataFrame([(*r, 0, "") for r in rows], TURNS)).collect()} == {
        (c, 0, None, 1, 0, 1, 0, sha(str(c)))} == trie(rows)


def test_ends_of_many_copies_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 20_000, 5) if zlib.crc32(str(c).encode()) % 9 == 0]
    got = prefix_trie.trie(spark.createDataFrame([(*r, 0, "") for r in rows], TURNS)).collect()
    assert {tuple(r) for r in got} == trie(rows)


# --- decontamination ------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, block long, term string, n long, place string"


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def benchmark_and_documents():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "a1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([12, 30]))) for i in range(8)] + [(8, "only four words here"), (9, ""), (10, None), (None, text(15)), (11, "the the " * 12)]
    items.append((12, items[0][1]))  # the same text twice
    docs = []
    for i in range(40):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w) - 9))
            parts += [", ".join(w[a:a + rng.randrange(8, 25)]).upper(), text(rng.randrange(5))]
        docs.append((i, "\n".join(parts)))
    docs += [(40, None), (41, ""), (42, "Only FOUR words—here"), (43, "only four words here"), (43, "only four words here"), (None, items[1][1]),
             (44, "the " * 3000 + "the-the"), (45, items[0][1] + " " + items[11][1])]
    return items, docs


def test_decontamination(spark):
    items, docs = benchmark_and_documents()
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[i:i + 10]), set()).add("" if item is None else str(item))
    want = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        want.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, class string")
    key = lambda r: tuple(map(str, r))
    got = contamination.digests(df, bench).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in contamination.contamination(df, bench).collect()}
    assert spans[44] == [(0, 3002)] and (0, len(words(items[0][1]))) in spans[45]
    assert {r.contaminated for r in contamination.digests(df, bench.limit(0)).collect()} == {False}
    assert contamination.digests(df.limit(0), bench).collect() == []


def test_phrases_do_not_cross_documents(spark):
    half = [" ".join(f"w{i}" for i in range(a, a + 6)) for a in (0, 6)]
    docs = spark.createDataFrame([(1, half[0]), (2, half[1])], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(half))], "item_id long, text string")
    assert [r.n_hit for r in contamination.contamination(docs, bench, slop=3).collect()] == [0, 0]


def test_proximity(spark):
    item = [f"w{i}" for i in range(10)]
    near = [*item[:4], "extra", *item[4:]]
    far = [*item[:4], *["extra"] * 5, *item[4:]]
    docs = spark.createDataFrame([(1, " ".join(["z", *near])), (2, " ".join(far)), (3, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: [(s.start, s.end, s.exact) for s in r.spans] for r in contamination.contamination(docs, bench, slop=2).collect()}
    assert got == {1: [(1, 12, False)], 2: [], 3: [(0, 10, True)]}
    assert [r.n_hit for r in contamination.contamination(docs, bench).orderBy("doc_id").collect()] == [0, 0, 10]


# --- manifest -------------------------------------------------------------------------------------

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = "doc_id long, text string, lang string, source string, n_chars long, pos long, path string, node string, part string"


def leaf(row, more=0):
    values = [row[c] if c != "n_chars" or row[c] is None else row[c] + more for c in COLUMNS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fan_in):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + fan_in])) for i in range(0, len(levels[-1]), fan_in)])
    return levels


def path(levels, i, fan_in):
    out = []
    for level in levels[:-1]:
        first = i - i % fan_in
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + fan_in])))
        i //= fan_in
    return out


def manifests(rows, fan_in=2):
    groups, want = {}, []
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in langs:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in groups[k]], fan_in) for k in langs}
    whole = tree([trees[k][-1][0] for k in langs], fan_in)
    for g, k in enumerate(langs):
        for i, row in enumerate(groups[k]):
            steps = path(trees[k], i, fan_in) + path(whole, g, fan_in)
            node = leaf(row, int(row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0))
            for a, b in steps:
                node = sha(a + node + b)
            root = whole[-1][0]
            want.append((row["doc_id"], leaf(row), trees[k][-1][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return want


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 3)
    rng = random.Random(6)
    rows = [{"doc_id": i, "text": rng.choice([None, "", "é" * i, "text"]), "lang": rng.choice(["en"] * 8 + ["de", None, "é", ""]),
             "source": rng.choice([None, "s"]), "n_chars": rng.choice([None, i])} for i in range(300)]
    rows += [{**rows[0], "doc_id": None}, {**rows[0], "doc_id": None}, {**rows[5], "text": "other"}, rows[5], {**rows[0], "lang": "alone"}]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "p", "n", "x") for r in rows], ROWS).repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, manifest.documents_manifest(df).collect()), key=key) == sorted(manifests(rows), key=key)
    assert manifest.documents_manifest(df.limit(0)).collect() == []
    own = manifest.leaf_hash({c: F.col(c) for c in COLUMNS})
    got = manifest.manifest(df, "lang", "doc_id", own, fan_in=3).select("leaf", "subroot", "root", "proof_sha256", "verified").collect()
    assert sorted(map(tuple, got)) == sorted((*w[1:5], True) for w in manifests(rows, 3))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_manifest_of_few_rows(spark, n):
    rows = [{"doc_id": i, "text": "t", "lang": "en", "source": "s", "n_chars": 1} for i in range(n)]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "p", "n", "x") for r in rows], ROWS)
    assert sorted(map(tuple, manifest.documents_manifest(df).collect())) == sorted(manifests(rows))
