"""SQL (DuckDB) for the queries that SQL can express, over whole tables."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = ("list_reduce(list_prepend(xor(c, b) & 255, range(8)), "
            "lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)")
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, {byte})))"


TRIE = f"""WITH RECURSIVE turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {crc32('c::VARCHAR')} % 9 AS h, (SELECT count(*) FROM turns b WHERE b.c = t.c - t.c % 5) AS m, count(*) AS n
  FROM turns t GROUP BY c),
seqs AS (SELECT v.c, t.i AS d, role, text FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.i <= h
  UNION ALL SELECT v.c, t.i - h + least(h, m), role, text FROM convs v JOIN turns t ON t.c = v.c AND t.i > h),
named AS (SELECT c, d, strlen(text) AS bytes, md5(string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS name FROM seqs
  UNION ALL SELECT c, 0, 0, '' FROM convs),
paths AS (SELECT *, min(c) OVER (PARTITION BY d, name) AS rep, d = max(d) OVER (PARTITION BY c) AS ends FROM named),
nodes AS (SELECT rep, d, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY rep, d),
parents AS (SELECT n.*, p.rep AS parent FROM nodes n LEFT JOIN paths p ON p.c = n.rep AND p.d = n.d - 1),
kids AS (SELECT n.*, (SELECT count(*) FROM parents k WHERE k.parent = n.rep AND k.d = n.d + 1) AS n_children FROM parents n),
sums AS (SELECT p.rep, p.d, count_if(k.n_children = 0)::BIGINT AS n_leaves, sum((k.n_convs - 1) * k.bytes)::BIGINT AS saved_tokens
  FROM kids k JOIN paths p ON p.c = k.rep AND p.d <= k.d GROUP BY p.rep, p.d)
SELECT rep AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM kids JOIN sums USING (rep, d)"""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS = f"""WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS size, list_slice(w, i, i + least(10, len(w)) - 1)::VARCHAR AS words
  FROM items, unnest(range(1, greatest(0, len(w) - least(10, len(w)) + 1) + 1)) t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT r, i, size, list_slice(w, i, i + size - 1)::VARCHAR AS words
  FROM (SELECT DISTINCT size FROM windows), docs, unnest(range(1, greatest(0, len(w) - size + 1) + 1)) t(i)),
found AS (SELECT r, i, g.size, item FROM grams g JOIN windows v ON g.words = v.words AND g.size = v.size),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) t(p) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


def _leaf(extra: str = "") -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
             for c in ("doc_id", "source", "lang", f"n_chars{extra}", "text")]
    return f"sha256({' || '.join(parts)})"


MERKLE = f"""WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_leaf()} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf(' + 1')} END AS claimed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low(l, lang, i, n, node) AS (SELECT 0, lang, i, n, leaf FROM placed
  UNION ALL SELECT l + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY l, lang, i // 2, n),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g, count(*) OVER () AS groups FROM low WHERE n = 1),
high(l, i, n, node) AS (SELECT 0, g, groups, subroot FROM subroots
  UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 2, n),
steps AS (SELECT p.r, b.l, p.i >> b.l AS slot, s.node FROM placed p JOIN (SELECT DISTINCT l, lang FROM low WHERE n > 1) b ON b.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN low s ON s.l = b.l AND s.lang IS NOT DISTINCT FROM p.lang AND s.i = xor(p.i >> b.l, 1)
  UNION ALL SELECT p.r, 1000 + b.l, g.g >> b.l, s.node FROM placed p JOIN subroots g ON g.lang IS NOT DISTINCT FROM p.lang
    CROSS JOIN (SELECT DISTINCT l FROM high WHERE n > 1) b LEFT JOIN high s ON s.l = b.l AND s.i = xor(g.g >> b.l, 1)),
proofs AS (SELECT r, list(node ORDER BY l) AS nodes, list(slot % 2 ORDER BY l) AS sides, sha256(coalesce(string_agg(node, '' ORDER BY l), '')) AS proof_sha256, count(*) AS depth FROM steps GROUP BY r),
folds(r, k, node) AS (SELECT r, 1, coalesce(claimed, leaf) FROM leaves
  UNION ALL SELECT f.r, k + 1, sha256(CASE WHEN sides[k] = 1 THEN coalesce(nodes[k], '') || node ELSE node || coalesce(nodes[k], '') END)
  FROM folds f JOIN proofs p ON p.r = f.r AND k <= depth),
ended AS (SELECT r, max_by(node, k) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT node FROM high WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = (SELECT node FROM high WHERE n = 1) AS verified
FROM placed p JOIN subroots g ON g.lang IS NOT DISTINCT FROM p.lang JOIN ended USING (r) LEFT JOIN proofs USING (r)"""

ORACLES = {"op11_conversation_prefix_trie": TRIE, "op12_benchmark_decontamination": LEAKS, "op13_merkle_manifest": MERKLE}
