"""The queries that SQL can express, for DuckDB, from their definitions: all windows, all shingles."""

from __future__ import annotations

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
PAPERS = "p AS (SELECT DISTINCT ON (paper_idx) * FROM paper WHERE paper_idx IS NOT NULL)"


def fields(*names: str) -> str:
    """CTE t (paper_idx, field_name, text) of some columns of all papers."""
    return "t AS (" + " UNION ALL ".join(f"SELECT paper_idx, '{n}' AS field_name, {n} AS text FROM p WHERE {n} IS NOT NULL" for n in names) + ")"


def windows(source: str, key: str, size: int) -> str:
    """(key, i, w): every window of ``size`` characters of ``text`` with its place from 0."""
    return f"(SELECT {key}, i, substring(text, i + 1, {size}) AS w FROM (SELECT {key}, text, unnest(range(length(text) - {size} + 1)) AS i FROM {source} WHERE length(text) >= {size}))"


SPANS = f"""{PAPERS}, {fields("introduction", "methods")}, w AS {windows("t", "paper_idx, field_name", 200)},
 several AS (SELECT w FROM w GROUP BY w HAVING min(paper_idx) < max(paper_idx)),
 starts AS (SELECT paper_idx, field_name, i, i - lag(i) OVER (PARTITION BY paper_idx, field_name ORDER BY i) AS step FROM w JOIN several USING (w)),
 islands AS (SELECT *, count(*) FILTER (step IS NULL OR step > 200) OVER (PARTITION BY paper_idx, field_name ORDER BY i) AS island FROM starts),
 spans AS (SELECT paper_idx, field_name AS section_name, min(i)::BIGINT AS start_pos, (max(i) + 200)::BIGINT AS end_pos FROM islands GROUP BY paper_idx, field_name, island)"""

LETTERS = r"regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')"
LEAKS = f"""d AS (SELECT doc_id, {LETTERS} AS text FROM documents WHERE doc_id IS NOT NULL), h AS (SELECT item_id, {LETTERS} AS text FROM heldout_item WHERE item_id IS NOT NULL),
 iw AS (SELECT DISTINCT item_id, w FROM {windows("h", "item_id", 100)})"""

SHINGLES = f"""{PAPERS}, {fields("full_text", "abstract")},
 s AS (SELECT DISTINCT paper_idx, field_name, hash(w) AS w FROM {windows(f"(SELECT paper_idx, field_name, regexp_replace(lower(text), '{SPACE}', '', 'g') AS text FROM t)", "paper_idx, field_name", 8)}),
 n AS (SELECT paper_idx, field_name, count(*) AS n FROM s GROUP BY ALL),
 met AS (SELECT a.paper_idx AS paper_a, b.paper_idx AS paper_b, field_name, count(*) AS m FROM s a JOIN s b USING (field_name, w) WHERE a.paper_idx < b.paper_idx GROUP BY ALL),
 similar_pairs AS (SELECT paper_a, paper_b, met.field_name, m = x.n AND m = y.n AS equal FROM met JOIN n x ON x.paper_idx = paper_a AND x.field_name = met.field_name JOIN n y ON y.paper_idx = paper_b AND y.field_name = met.field_name WHERE m >= 0.6 * (x.n + y.n - m))"""
EDGES = """e AS (SELECT field_name, paper_a AS u, paper_b AS v, equal FROM similar_pairs UNION ALL SELECT field_name, paper_b, paper_a, equal FROM similar_pairs),
 r AS (SELECT field_name, u AS paper_idx, u AS low FROM e UNION SELECT e.field_name, e.v, r.low FROM r JOIN e ON e.field_name = r.field_name AND e.u = r.paper_idx),
 grp AS (SELECT field_name, paper_idx, min(low) AS group_id FROM r GROUP BY ALL),
 cls AS (SELECT n.field_name, n.paper_idx, least(n.paper_idx, coalesce(min(e.v), n.paper_idx)) AS class_id FROM n LEFT JOIN e ON e.field_name = n.field_name AND e.u = n.paper_idx AND e.equal GROUP BY n.field_name, n.paper_idx),
 lnk AS (SELECT e.field_name, u AS paper_idx, count(DISTINCT c.class_id) AS links FROM e JOIN cls c ON c.field_name = e.field_name AND c.paper_idx = e.v WHERE NOT e.equal GROUP BY e.field_name, u)"""

ORACLE = {
    "p4_found": f"WITH {SHINGLES} SELECT paper_a, paper_b, field_name FROM similar_pairs",
    "p4_groups": f"WITH RECURSIVE {SHINGLES}, {EDGES} SELECT paper_idx, field_name, class_id, coalesce(group_id, class_id) AS group_id, coalesce(links, 0)::BIGINT AS links FROM cls LEFT JOIN grp USING (field_name, paper_idx) LEFT JOIN lnk USING (field_name, paper_idx)",
    "p6_found": f"WITH {SPANS} SELECT paper_idx, section_name, start_pos, end_pos FROM spans",
    "p6_share": f"""WITH {SPANS}, sums AS (SELECT paper_idx, section_name, sum(end_pos - start_pos)::BIGINT AS shared FROM spans GROUP BY ALL)
SELECT t.paper_idx, field_name AS section_name, length(text)::BIGINT AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(shared, 0) / length(text), 4) ELSE 0.0 END AS share
 FROM t LEFT JOIN sums ON sums.paper_idx = t.paper_idx AND section_name = field_name""",
    "p8_found": f"WITH {LEAKS} SELECT DISTINCT doc_id, item_id FROM {windows('d', 'doc_id', 100)} JOIN iw USING (w)",
}
