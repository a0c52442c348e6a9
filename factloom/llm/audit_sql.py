"""SQL of the filter audit and of the manifest; the manifest's levels are written out, for up to 8**8 documents of a language and 8**4 languages."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
FILTER_AUDIT = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len({_WORDS}) < 50)::INTEGER * 1 + (100 * len(list_distinct({_WORDS})) < 65 * len({_WORDS}))::INTEGER * 2
    + (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INTEGER * 4 + regexp_matches(t, '[#$%&*|]')::INTEGER * 8 + coalesce(doc_id > first, false)::INTEGER * 16 AS bits
  FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (bits & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & before = 0 AND bits & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (bits & before <> 0 AND bits & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (bits & before = 0 AND bits & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bits & before = 0 AND bits & bit <> 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


A, B = 8, 4


def _climb(name: str, base: str, depth: int) -> str:
    """CTEs {name}0 to {name}{depth} of (tree, pos, h, n), each level's nodes, {name}s of (level, tree, pos, l, r), what stands beside each, and {name}r, the roots."""
    parts = [f"{name}0 AS MATERIALIZED ({base})"]
    for k in range(depth):
        up = f"SELECT tree, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 8"
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({up}))")
    beside = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN {} AND {}), '')"
    sides = " UNION ALL ".join(f"SELECT {k} AS level, tree, pos, {beside.format('UNBOUNDED PRECEDING', '1 PRECEDING')} AS l, {beside.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS r FROM {name}{k} WHERE n > 1" for k in range(depth))
    roots = " UNION ALL ".join(f"SELECT tree, h AS root FROM {name}{k} WHERE n = 1" for k in range(depth + 1))
    return ",\n".join([*parts, f"{name}s AS MATERIALIZED ({sides})", f"{name}r AS MATERIALIZED ({roots})"])


def _folds() -> str:
    """CTEs f1 to f{A + B}: f0's documents with what stands beside them added to proof and folded into h, up the language's tree and then the languages'."""
    made = []
    for k in range(A + B):
        of, tree, pos, level = ("lang_", "x.tree", "x.pos", k) if k < A else ("top_", "''", "x.top", k - A)
        made.append(f"f{k + 1} AS MATERIALIZED (SELECT x.doc_id, x.tree, x.pos, x.top, x.leaf, x.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.level IS NULL THEN x.h ELSE sha256(s.l || x.h || s.r) END AS h FROM f{k} x LEFT JOIN {of}s s ON s.level = {level} AND s.tree = {tree} AND s.pos = {pos} // {8**level})")
    return ",\n".join(made)


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = _field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
# the checksum by its rule, bit by bit: reflected polynomial 0xEDB88320
_CRC = "xor(4294967295::BIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, xor(c, b)), 4294967295::BIGINT))"
MERKLE_MANIFEST = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce('v' || lang, 'n') AS tree, sha256({_HEAD} || {_field('text')}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_LOWER}) END AS tampered FROM documents
), p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), {_climb('lang_', 'SELECT tree, pos, leaf AS h, n FROM p', A)},
t AS MATERIALIZED (SELECT tree, root, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lang_r),
{_climb('top_', "SELECT '' AS tree, pos, root AS h, n FROM t", B)},
f0 AS MATERIALIZED (SELECT p.doc_id, p.tree, p.pos, t.pos AS top, p.leaf, '' AS proof, coalesce(p.tampered, p.leaf) AS h FROM p JOIN t USING (tree)),
{_folds()}
SELECT doc_id, leaf, t.root AS subroot, top_r.root AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = top_r.root AS verified FROM f{A + B} JOIN t USING (tree), top_r"""
