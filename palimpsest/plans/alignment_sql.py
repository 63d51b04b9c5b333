"""DuckDB twins of the order-dependent alignments: the same rules as recursive queries over small groups.

A longest common subsequence is a table of lengths, one list a row from the last row up, and a
walk through it; greedy pairings carry what is taken in a list.
"""

from __future__ import annotations


def lcs(old: str, new: str, p: str) -> str:
    """CTEs that end in {p}p (u, old_idx, new_idx): alignment of CTEs (u, idx, sig); on ties the old side advances."""
    return f"""
{p}_s AS (SELECT coalesce(a.u, b.u) AS u, coalesce(a.s, []) AS a, coalesce(b.s, []) AS b, a.ids AS ai, b.ids AS bi FROM (SELECT u, list(sig ORDER BY idx) AS s, list(idx ORDER BY idx) AS ids FROM {old} GROUP BY u) a FULL JOIN (SELECT u, list(sig ORDER BY idx) AS s, list(idx ORDER BY idx) AS ids FROM {new} GROUP BY u) b ON a.u = b.u),
{p}_t AS (SELECT u, len(a) AS i, list_transform(range(len(b) + 1), lambda x: CAST(0 AS BIGINT)) AS l FROM {p}_s UNION ALL
  SELECT t.u, t.i - 1, list_append(list_transform(range(1, len(s.b) + 1), lambda j: list_max(list_transform(range(j, len(s.b) + 1), lambda k: CASE WHEN s.b[k] = s.a[t.i] THEN t.l[k + 1] + 1 ELSE t.l[k] END))), CAST(0 AS BIGINT)) FROM {p}_t t JOIN {p}_s s ON t.u = s.u WHERE t.i > 0),
{p}_w AS (SELECT u, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j FROM {p}_s UNION ALL
  SELECT w.u, w.i + CASE WHEN s.a[w.i + 1] = s.b[w.j + 1] OR lo.l[w.j + 1] >= hi.l[w.j + 2] THEN 1 ELSE 0 END, w.j + CASE WHEN s.a[w.i + 1] = s.b[w.j + 1] OR lo.l[w.j + 1] < hi.l[w.j + 2] THEN 1 ELSE 0 END
  FROM {p}_w w JOIN {p}_s s ON w.u = s.u JOIN {p}_t lo ON lo.u = w.u AND lo.i = w.i + 1 JOIN {p}_t hi ON hi.u = w.u AND hi.i = w.i WHERE w.i < len(s.a) AND w.j < len(s.b)),
{p}p AS (SELECT w.u, s.ai[w.i + 1] AS old_idx, s.bi[w.j + 1] AS new_idx FROM {p}_w w JOIN {p}_s s ON w.u = s.u WHERE w.i < len(s.a) AND w.j < len(s.b) AND s.a[w.i + 1] = s.b[w.j + 1])"""


def residual(old: str, new: str, p: str, most: float = 72.0) -> str:
    """CTEs that end in {p}p (u, old_idx, new_idx): each old row of CTE (u, sig, idx, x, y) takes its nearest free new one of its signature."""
    side = lambda t, c: f"(SELECT u, sig, list(idx ORDER BY idx) AS {c}i, list(x ORDER BY idx) AS {c}x, list(y ORDER BY idx) AS {c}y FROM {t} GROUP BY u, sig)"
    return f"""
{p}g AS (SELECT * FROM {side(old, 'o')} JOIN {side(new, 'n')} USING (u, sig)),
{p}r AS (SELECT u, sig, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS k FROM {p}g UNION ALL
  SELECT u, sig, i + 1, CASE WHEN list_min(d) < {most} THEN list_append(used, CAST(list_position(d, list_min(d)) AS BIGINT)) ELSE used END, CASE WHEN list_min(d) < {most} THEN CAST(list_position(d, list_min(d)) AS BIGINT) END
  FROM (SELECT r.u, r.sig, r.i, r.used, list_transform(range(1, len(g.ni) + 1), lambda j: CASE WHEN list_contains(r.used, j) THEN CAST('infinity' AS DOUBLE) ELSE sqrt(pow(g.nx[j] - g.ox[r.i + 1], 2) + pow(g.ny[j] - g.oy[r.i + 1], 2)) END) AS d FROM {p}r r JOIN {p}g g ON r.u = g.u AND r.sig = g.sig WHERE r.i < len(g.oi))),
{p}p AS (SELECT r.u, g.oi[r.i] AS old_idx, g.ni[r.k] AS new_idx FROM {p}r r JOIN {p}g g ON r.u = g.u AND r.sig = g.sig WHERE r.k IS NOT NULL)"""


def nearest(old: str, new: str, p: str) -> str:
    """CTEs that end in {p}p (u, old_idx, new_idx, d): rows of CTEs (u, idx, x, y, z) paired one to one, closest first."""
    return f"""
{p}c AS (SELECT a.u, list({{'i': a.idx, 'j': b.idx, 'd': a.d}} ORDER BY a.d, a.idx, b.idx) AS l, least(count(DISTINCT a.idx), count(DISTINCT b.idx)) AS most
  FROM (SELECT a.u, a.idx, b.idx AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM {old} a JOIN {new} b ON a.u = b.u) a JOIN {new} b ON a.u = b.u AND a.j = b.idx GROUP BY a.u),
{p}r AS (SELECT u, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS is_, CAST([] AS BIGINT[]) AS js, FALSE AS hit FROM {p}c UNION ALL
  SELECT u, n + 1, CASE WHEN free THEN list_append(is_, CAST(e.i AS BIGINT)) ELSE is_ END, CASE WHEN free THEN list_append(js, CAST(e.j AS BIGINT)) ELSE js END, free
  FROM (SELECT r.u, r.n, r.is_, r.js, c.l[r.n + 1] AS e, NOT list_contains(r.is_, CAST(c.l[r.n + 1].i AS BIGINT)) AND NOT list_contains(r.js, CAST(c.l[r.n + 1].j AS BIGINT)) AS free FROM {p}r r JOIN {p}c c ON r.u = c.u WHERE r.n < len(c.l) AND len(r.is_) < c.most)),
{p}p AS (SELECT r.u, c.l[r.n].i AS old_idx, c.l[r.n].j AS new_idx, c.l[r.n].d AS d FROM {p}r r JOIN {p}c c ON r.u = c.u WHERE r.hit)"""


DOC_LINES = """l AS (SELECT doc_id AS u, CAST(unnest(range(len(x))) AS INTEGER) AS idx, unnest(x) AS sig FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS x FROM documents WHERE text <> '')),
e AS (SELECT u, CAST(idx * 2 + c AS INTEGER) AS idx, sig FROM l, (SELECT unnest([1, 2]) AS c) WHERE c <= CASE WHEN idx % 7 = 6 THEN 0 WHEN idx % 11 = 10 THEN 2 ELSE 1 END),"""
LCS_PAIRS = f"WITH RECURSIVE {DOC_LINES}{lcs('l', 'e', 'a')}\nSELECT u AS doc_id, old_idx, new_idx, FALSE AS lcs_refused FROM ap"

#: Longest common stretches, recursively: a run of equal lines along one diagonal is cut to the range in hand.
LINE_STATES = f"""WITH RECURSIVE {DOC_LINES}
a AS (SELECT u, sig, row_number() OVER (PARTITION BY u ORDER BY idx) - 1 AS i FROM l), b AS (SELECT u, sig, row_number() OVER (PARTITION BY u ORDER BY idx) - 1 AS j FROM e),
n AS (SELECT coalesce(x.u, y.u) AS u, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM (SELECT u, count(*) AS n FROM a GROUP BY u) x FULL JOIN (SELECT u, count(*) AS n FROM b GROUP BY u) y ON x.u = y.u),
m AS (SELECT a.u, i, j, i - row_number() OVER (PARTITION BY a.u, i - j ORDER BY i) AS g FROM a JOIN b ON a.u = b.u AND a.sig = b.sig),
s AS (SELECT u, min(i) AS i0, min(j) AS j0, count(*) AS k FROM m GROUP BY u, i - j, g),
r AS (SELECT u, CAST(0 AS BIGINT) AS i1, na AS i2, CAST(0 AS BIGINT) AS j1, nb AS j2, FALSE AS block FROM n UNION ALL
  SELECT u, t.i1, t.i2, t.j1, t.j2, t.block FROM (SELECT u, unnest([{{'i1': i1, 'i2': x.i, 'j1': j1, 'j2': x.j, 'block': FALSE}}, {{'i1': x.i, 'i2': x.i + x.k, 'j1': x.j, 'j2': x.j + x.k, 'block': TRUE}}, {{'i1': x.i + x.k, 'i2': i2, 'j1': x.j + x.k, 'j2': j2, 'block': FALSE}}]) AS t
    FROM (SELECT r.u, i1, i2, j1, j2, list({{'k': least(i0 + k, i2, i0 + j2 - j0) - greatest(i0, i1, i0 + j1 - j0), 'i': greatest(i0, i1, i0 + j1 - j0), 'j': greatest(i0, i1, i0 + j1 - j0) - i0 + j0}}
        ORDER BY greatest(i0, i1, i0 + j1 - j0) - least(i0 + k, i2, i0 + j2 - j0), greatest(i0, i1, i0 + j1 - j0), greatest(i0, i1, i0 + j1 - j0) - i0 + j0)[1] AS x
      FROM r JOIN s ON r.u = s.u AND NOT block AND least(i0 + k, i2, i0 + j2 - j0) > greatest(i0, i1, i0 + j1 - j0) GROUP BY r.u, i1, i2, j1, j2))),
c AS (SELECT u, i1, i2, j1, j2 FROM r WHERE block UNION ALL SELECT u, na, na, nb, nb FROM n),
g AS (SELECT u, i2 - i1 AS k, i1 - lag(i2, 1, 0) OVER w AS gone, j1 - lag(j2, 1, 0) OVER w AS come FROM c WINDOW w AS (PARTITION BY u ORDER BY i1, i2)),
o AS (SELECT u, unnest([{{'layer': 'diff-old', 'state': 'unchanged', 'n': k}}, {{'layer': 'diff-new', 'state': 'unchanged', 'n': k}}, {{'layer': 'diff-old', 'state': 'deleted', 'n': gone}}, {{'layer': 'diff-new', 'state': 'added', 'n': come}},
  {{'layer': 'diff-changes', 'state': CASE WHEN gone > 0 AND come > 0 THEN 'modified' WHEN gone > 0 THEN 'deleted' ELSE 'added' END, 'n': gone + come}}]) AS t FROM g)
SELECT u AS doc_id, t.layer AS layer, t.state AS state, CAST(sum(t.n) AS BIGINT) AS n FROM o WHERE t.n > 0 GROUP BY ALL"""

PAGE_PAIRING = f"""WITH RECURSIVE o AS (SELECT conv_id AS u, CAST(turn AS INTEGER) AS idx, md5(text) AS sig FROM conversations),
n AS (SELECT u, idx, CASE WHEN idx % 5 = 2 THEN md5(sig) ELSE sig END AS sig FROM o WHERE (u + idx) % 7 <> 3),{lcs('o', 'n', 'a')},
ro AS (SELECT u, idx, row_number() OVER (PARTITION BY u ORDER BY idx) AS k FROM o WHERE NOT EXISTS (SELECT 1 FROM ap WHERE ap.u = o.u AND ap.old_idx = o.idx)),
rn AS (SELECT u, idx, row_number() OVER (PARTITION BY u ORDER BY idx) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM ap WHERE ap.u = n.u AND ap.new_idx = n.idx)),
z AS (SELECT u, old_idx, new_idx FROM ap UNION ALL SELECT coalesce(ro.u, rn.u), ro.idx, rn.idx FROM ro FULL JOIN rn ON ro.u = rn.u AND ro.k = rn.k)
SELECT u AS conv_id, old_idx, new_idx, CAST(row_number() OVER (PARTITION BY u ORDER BY new_idx NULLS LAST, old_idx NULLS LAST) - 1 AS INTEGER) AS seq FROM z"""

PAGES = """b AS (SELECT p_brand || '/' || p_size AS u, CAST(p_partkey AS INTEGER) AS idx, 'P|' || p_type AS sig, CAST(p_partkey % 500 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_partkey AS k FROM part),
o AS (SELECT u, idx, sig, x, y, 'w=1.0' AS style FROM b WHERE k % 17 <> 0),
n AS (SELECT u, idx, sig, x + CASE WHEN k % 11 = 0 THEN 40 WHEN k % 23 = 0 THEN 400 ELSE 5 END AS x, y, CASE WHEN k % 13 = 0 THEN 'w=2.0' ELSE 'w=1.0' END AS style FROM b WHERE k % 19 <> 0),"""
RESIDUAL_NEAREST = f"WITH RECURSIVE {PAGES}{residual('o', 'n', 'a')}\nSELECT u AS page, old_idx, new_idx FROM ap"

#: Deltas d (u, state, reason, old_idx, new_idx, matched) of the pages.
COMPARED = f"""WITH RECURSIVE {PAGES}
v AS (SELECT u, round_even(q.x - p.x, 0) AS dx, round_even(q.y - p.y, 0) AS dy, count(*) AS c FROM (SELECT u, sig, min(x) AS x, min(y) AS y FROM o GROUP BY 1, 2 HAVING count(*) = 1) p JOIN (SELECT u, sig, min(x) AS x, min(y) AS y FROM n GROUP BY 1, 2 HAVING count(*) = 1) q USING (u, sig) GROUP BY 1, 2, 3),
h AS (SELECT z.u, coalesce(max(t.dx), 0.0) AS dx, coalesce(max(t.dy), 0.0) AS dy FROM (SELECT DISTINCT u FROM b) z LEFT JOIN (SELECT *, sum(c) OVER (PARTITION BY u) AS s FROM v) t ON z.u = t.u AND t.c * 2 > t.s GROUP BY z.u),{lcs('o', 'n', 'a')},
fo AS (SELECT o.u, o.idx, o.sig, o.x + h.dx AS x, o.y + h.dy AS y FROM o JOIN h ON o.u = h.u WHERE NOT EXISTS (SELECT 1 FROM ap WHERE ap.u = o.u AND ap.old_idx = o.idx)),
fn AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM ap WHERE ap.u = n.u AND ap.new_idx = n.idx)),{residual('fo', 'fn', 'r')},
m AS (SELECT p.u, p.old_idx, p.new_idx, sqrt(pow(n.x - (o.x + h.dx), 2) + pow(n.y - (o.y + h.dy), 2)) AS d, o.style <> n.style AS restyled FROM (SELECT * FROM ap UNION ALL SELECT * FROM rp) p JOIN o ON o.u = p.u AND o.idx = p.old_idx JOIN n ON n.u = p.u AND n.idx = p.new_idx JOIN h ON h.u = p.u),
k AS (SELECT *, CASE WHEN d > 72 THEN 'relocated' ELSE concat_ws('+', CASE WHEN d > 0.75 THEN printf('moved %.1f', d) END, CASE WHEN restyled THEN 'style' END) END AS reason FROM m),
d AS (SELECT u, CASE WHEN reason = '' THEN 'unchanged' ELSE 'modified' END AS state, reason, old_idx, new_idx, TRUE AS matched FROM k WHERE d <= 72
  UNION ALL SELECT u, 'deleted', reason, old_idx, NULL, TRUE FROM k WHERE d > 72 UNION ALL SELECT u, 'added', reason, NULL, new_idx, FALSE FROM k WHERE d > 72
  UNION ALL SELECT u, 'deleted', '', idx, NULL, FALSE FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.u = o.u AND m.old_idx = o.idx) UNION ALL SELECT u, 'added', '', NULL, idx, FALSE FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.u = n.u AND m.new_idx = n.idx))
"""
PAGE_COMPARISON = COMPARED + "SELECT u AS page, state, reason, old_idx, new_idx, matched FROM d"
PAGE_CONFIDENCE = COMPARED + """, c AS (SELECT u, (SELECT count(*) FROM o WHERE o.u = z.u) AS a, (SELECT count(*) FROM n WHERE n.u = z.u) AS b, (SELECT count(*) FROM d WHERE d.u = z.u AND d.matched) AS m FROM (SELECT DISTINCT u FROM d) z)
SELECT u AS page, CASE WHEN least(a, b) = 0 THEN 1.0 ELSE round_even(least(CAST(m AS DOUBLE) / least(a, b), 1.0), 4) END AS confidence FROM c"""
_PATH = """'<path data-diff-state="' || {0} || '" data-diff-kind="path" d="M0,0 L1,1" stroke-width="' || CASE {1} WHEN 'w=2.0' THEN '2' ELSE '1' END || '" fill="none"/>'"""
PAGE_DRAWINGS = COMPARED + f""", s AS (SELECT d.*, o.style AS os, n.style AS ns, row_number() OVER (PARTITION BY d.u ORDER BY CASE WHEN d.new_idx IS NULL THEN 1 WHEN d.old_idx IS NULL THEN 2 ELSE 0 END, d.old_idx NULLS FIRST, d.new_idx NULLS FIRST) AS q FROM d LEFT JOIN o ON o.u = d.u AND o.idx = d.old_idx LEFT JOIN n ON n.u = d.u AND n.idx = d.new_idx),
w AS (SELECT u, string_agg({_PATH.format("CASE WHEN state IN ('deleted', 'modified') THEN state ELSE 'unchanged' END", 'os')}, '' ORDER BY q) FILTER (old_idx IS NOT NULL) AS a, string_agg({_PATH.format("CASE WHEN state IN ('added', 'modified') THEN state ELSE 'unchanged' END", 'ns')}, '' ORDER BY q) FILTER (new_idx IS NOT NULL) AS b, string_agg({_PATH.format('state', 'coalesce(ns, os)')}, '' ORDER BY q) FILTER (state <> 'unchanged') AS c FROM s GROUP BY u)
SELECT u AS page, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 595 842" width="595" height="842" data-diff-mode="vector"><g transform="translate(0,842) scale(1,-1)"><g id="diff-old">' || coalesce(a, '') || '</g><g id="diff-new">' || coalesce(b, '') || '</g><g id="diff-changes">' || coalesce(c, '') || '</g></g></svg>' AS svg FROM w"""

_SUM = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(21), lambda i: v[3 * i + {0}])), lambda a, b: a + b) / 21"
#: Elements c (vec_id, label, v, cx, cy, cz) by sums in order.
PLACED = "e AS (SELECT vec_id, label, list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def centred(source: str) -> str:
    return f"SELECT *, {_SUM.format(1)} AS cx, {_SUM.format(2)} AS cy, {_SUM.format(3)} AS cz FROM {source}"


_REL = "list_transform(range(63), lambda i: v[i + 1] - CASE i % 3 WHEN 0 THEN cx WHEN 1 THEN cy ELSE cz END)"
_SHAPE = f"substr(sha256(list_reduce(list_prepend('', list_transform({_REL}, lambda x: CAST(CAST(round_even(x / 0.0001, 0) AS BIGINT) AS VARCHAR) || ',')), lambda a, b: a || b) || '|0,1,2,'), 1, 32)"
SHAPE_SIGNATURE = f"WITH {PLACED}, c AS ({centred('e')}) SELECT vec_id, {_SHAPE} AS shape FROM c"
NEAREST_FIRST = f"""WITH RECURSIVE {PLACED}, c AS ({centred('e')}),
o AS (SELECT 's' || label AS u, CAST(vec_id AS INTEGER) AS idx, cx AS x, cy AS y, cz AS z FROM c WHERE vec_id % 17 <> 0), n AS (SELECT 's' || label AS u, CAST(vec_id AS INTEGER) AS idx, cx AS x, cy AS y, cz AS z FROM c WHERE vec_id % 19 <> 0),{nearest('o', 'n', 'a')}
SELECT old_idx, new_idx, round(d, 9) AS distance FROM ap"""
_AXIS = "max(list_max(list_transform(range(21), lambda i: v[3 * i + {0}]))) - min(list_min(list_transform(range(21), lambda i: v[3 * i + {0}])))"
_DIAGONAL = f"SELECT label, sqrt(pow({_AXIS.format(1)}, 2) + pow({_AXIS.format(2)}, 2) + pow({_AXIS.format(3)}, 2)) AS g FROM {{0}} GROUP BY label"
SHAPE_COMPARISON = f"""WITH RECURSIVE {PLACED}, eo AS ({centred('(SELECT * FROM e WHERE vec_id % 17 <> 0)')}),
en AS ({centred("(SELECT vec_id, label, list_transform(v, lambda x: x + CASE WHEN vec_id % 11 = 0 THEN 10.0 WHEN vec_id % 13 = 0 THEN 0.001 ELSE 0.0 END) AS v FROM e WHERE vec_id % 19 <> 0)")}),
o AS (SELECT label, label || '|' || {_SHAPE} AS u, CAST(vec_id AS INTEGER) AS idx, cx AS x, cy AS y, cz AS z FROM eo), n AS (SELECT label, label || '|' || {_SHAPE} AS u, CAST(vec_id AS INTEGER) AS idx, cx AS x, cy AS y, cz AS z FROM en),{nearest('o', 'n', 'a')},
g AS (SELECT label, max(g) AS g FROM ({_DIAGONAL.format('eo')} UNION ALL {_DIAGONAL.format('en')}) GROUP BY label),
m AS (SELECT o.label, ap.*, ap.d <= CASE WHEN g.g > 0 THEN g.g ELSE 1 END * 0.02 AS near FROM ap JOIN o ON o.u = ap.u AND o.idx = ap.old_idx JOIN g ON g.label = o.label)
SELECT label AS model, 'unchanged' AS state, old_idx, new_idx, TRUE AS matched FROM m WHERE near UNION ALL SELECT label, 'deleted', old_idx, NULL, TRUE FROM m WHERE NOT near UNION ALL SELECT label, 'added', NULL, new_idx, FALSE FROM m WHERE NOT near
UNION ALL SELECT label, 'deleted', idx, NULL, FALSE FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.old_idx = o.idx) UNION ALL SELECT label, 'added', NULL, idx, FALSE FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.new_idx = n.idx)"""
