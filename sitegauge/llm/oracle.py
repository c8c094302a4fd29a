"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id > first_doc, false) AS gone
  FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: CRC-32 of a text by its table of 256 steps; ``<text>`` stands for it.
_CRC_STEPS = """
steps(byte, k, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8)"""
_CRC = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(<text>)), '..'),
               lambda h: ('0x' || h)::BIGINT)),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295)"""

SHARDING = f"""
WITH RECURSIVE {_CRC_STEPS},
records AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '-') AS key, strlen(coalesce(text, '')) + 1 AS size,
         {_CRC.replace('<text>', "coalesce(text, '')")} AS text_crc32
  FROM documents, crc),
scores AS (
  SELECT key, range AS shard,
         ln((('0x' || substr(md5(key || ':' || range), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
  FROM (SELECT DISTINCT key FROM records), range(17)),
placed AS (
  SELECT key, arg_max(shard, score) FILTER (shard < 16) AS shard, arg_max(shard, score) AS grown_shard
  FROM scores GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM records JOIN placed USING (key)
"""

_VALUE = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_LEAF_WITHOUT_LINE_ENDS = _LEAF.replace("text::VARCHAR", "replace(text, chr(10), '')")

MANIFEST = f"""
WITH RECURSIVE {_CRC_STEPS},
hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC.replace('<text>', "coalesce(doc_id::VARCHAR, '')")} % 2 = 0
              THEN {_LEAF_WITHOUT_LINE_ENDS} ELSE {_LEAF} END AS changed
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n FROM hashed),
nodes(tree, lvl, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 3),
tops AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
         FROM nodes WHERE n = 1),
upper_nodes(lvl, idx, n, digest) AS (
  SELECT 0, idx, n, subroot FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper_nodes WHERE n > 1 GROUP BY lvl, idx // 3),
beside AS (
  SELECT o.tree, o.lvl, o.idx, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < o.idx), '') AS l,
         coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > o.idx), '') AS r
  FROM nodes o JOIN nodes s ON o.tree = s.tree AND o.lvl = s.lvl AND o.idx // 3 = s.idx // 3
  WHERE o.n > 1 GROUP BY ALL),
upper_beside AS (
  SELECT o.lvl, o.idx, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < o.idx), '') AS l,
         coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > o.idx), '') AS r
  FROM upper_nodes o JOIN upper_nodes s ON o.lvl = s.lvl AND o.idx // 3 = s.idx // 3
  WHERE o.n > 1 GROUP BY ALL),
folds(doc_id, leaf, tree, lvl, idx, own, proof) AS (
  SELECT doc_id, leaf, tree, 0, idx, changed, '' FROM leaves
  UNION ALL
  SELECT doc_id, leaf, f.tree, f.lvl + 1, f.idx // 3, sha256(l || own || r), proof || l || r
  FROM folds f JOIN beside b ON f.tree = b.tree AND f.lvl = b.lvl AND f.idx = b.idx),
inner_ends AS (
  SELECT f.*, subroot, tops.idx AS of_tree FROM folds f JOIN nodes USING (tree, lvl, idx) JOIN tops USING (tree)
  WHERE nodes.n = 1),
upper_folds(doc_id, leaf, subroot, lvl, idx, own, proof) AS (
  SELECT doc_id, leaf, subroot, 0, of_tree, own, proof FROM inner_ends
  UNION ALL
  SELECT doc_id, leaf, subroot, f.lvl + 1, f.idx // 3, sha256(l || own || r), proof || l || r
  FROM upper_folds f JOIN upper_beside b ON f.lvl = b.lvl AND f.idx = b.idx)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, own AS folded_root,
       own = digest AS verified
FROM upper_folds JOIN upper_nodes USING (lvl, idx) WHERE upper_nodes.n = 1
"""


def statements() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP, "op11_sharding": SHARDING, "op13_manifest": MANIFEST}
