"""The queries of queries.py that SQL can express, as DuckDB runs them."""

from __future__ import annotations

#: Near-duplicates by counting the shared shingles of every pair that shares one, and the closure of the links.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words
), shingle AS (SELECT DISTINCT doc_id, unnest(s) AS h FROM runs),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM runs),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, edge.y FROM reach JOIN edge ON reach.r = edge.x)
SELECT s.doc_id, s.n AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM sizes s JOIN reach ON reach.v = s.doc_id GROUP BY s.doc_id, s.n
"""

#: The highest level of a tree that the SQL looks at: 8 ** 8 rows of a group, 8 ** 5 groups.
_ROW_LEVELS, _GROUP_LEVELS = 8, 5


def _levels(name: str, top: int) -> str:
    """Level tables <name>1 to <name><top> over <name>0 (g, i, node), and <name>_s<k>: the siblings of each node of level k."""
    parts = []
    for k in range(top):
        parts.append(
            f"{name}_c{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}), "
            f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node FROM {name}_c{k} GROUP BY g, i // 8), "
            f"{name}_s{k} AS MATERIALIZED (SELECT a.g, a.i, max(a.n) AS n, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
            f"FROM {name}_c{k} a JOIN {name}_c{k} b ON a.g = b.g AND a.i // 8 = b.i // 8 GROUP BY a.g, a.i)"
        )
    return ", ".join(parts)


def _folds() -> str:
    """The rows (id, leaf, now, i, g, u: place of the group) with f, folded level by level, and p, the siblings so far."""
    parts, last = [], "f0"
    steps = [("row", k, "g", "i") for k in range(_ROW_LEVELS)] + [("top", k, "0", "u") for k in range(_GROUP_LEVELS)]
    for at, (name, k, g, place) in enumerate(steps, 1):
        parts.append(
            f"f{at} AS (SELECT x.id, x.leaf, x.i, x.g, x.u, CASE WHEN s.n = 1 THEN x.f ELSE sha256(s.l || x.f || s.r) END AS f, x.p || s.l || s.r AS p "
            f"FROM {last} x JOIN {name}_s{k} s ON s.g = x.{g} AND s.i = x.{place} // {8**k})".replace("x.0", "'0'")
        )
        last = f"f{at}"
    return ", ".join(parts)


_CRC_STEP = "list_reduce([{c}] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, o: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
_FIELD = "coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A Merkle tree level by level; crc32 over the digits of the id.
MERKLE_SQL = f"""
WITH doc AS (
  SELECT doc_id AS id, coalesce('1' || lang, '0') AS g, {" || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, {_FIELD.format(c="text")} AS body, {_FIELD.format(c=_LOWER)} AS low,
    list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT), lambda c, b: {_CRC_STEP.format(c="xor(c, b)")}) AS c FROM documents
), hashed AS (
  SELECT id, g, sha256(head || body) AS leaf, CASE WHEN xor(c, 4294967295::UBIGINT) % 3 = 0 THEN sha256(head || low) ELSE sha256(head || body) END AS now FROM doc
), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id NULLS FIRST, leaf) - 1 AS i FROM hashed),
row0 AS (SELECT g, i, leaf AS node FROM placed), {_levels("row", _ROW_LEVELS)},
top0 AS MATERIALIZED (SELECT '0' AS g, row_number() OVER (ORDER BY g) - 1 AS i, node, g AS of FROM row{_ROW_LEVELS}),
{_levels("top", _GROUP_LEVELS)},
f0 AS (SELECT p.id, p.leaf, p.i, p.g, t.i AS u, p.now AS f, '' AS p FROM placed p JOIN top0 t ON t.of = p.g), {_folds()}
SELECT f.id AS doc_id, f.leaf, t.node AS subroot, r.node AS root, sha256(f.p) AS proof_sha256, f.f AS folded_root, f.f = r.node AS verified
FROM f{_ROW_LEVELS + _GROUP_LEVELS} f JOIN top0 t ON t.of = f.g CROSS JOIN top{_GROUP_LEVELS} r
"""

#: Scores by joining the terms of items with those of documents.
SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM words),
corpus AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
asked AS (
  SELECT item_id, term, count(*) AS often FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term) CROSS JOIN corpus
), scores AS (
  SELECT item_id, doc_id, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id) CROSS JOIN corpus GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
