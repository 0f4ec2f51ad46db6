"""SQL fragments of the graph queries: longest paths by blocks, holes across nodes, best paths of regions, and the whole way to peaks.

Walks are recursive. They stay within a block, a hole or a region, all of them short.
"""

from __future__ import annotations

from pathtide.plans.base import islands_sql

#: CTEs that end in lmap(chrom, node_id, size, lin_start, lin_end). They need edge.
LMAP = """far AS (SELECT src AS node_id, max(dst) AS far FROM edge GROUP BY src),
cuts AS (SELECT chrom, node_id, node_size AS size, CASE WHEN coalesce(max(far) OVER (PARTITION BY chrom ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= node_id THEN 1 ELSE 0 END AS is_cut
  FROM nodes LEFT JOIN far USING (node_id)),
blk AS (SELECT chrom, node_id, size, CAST(sum(is_cut) OVER (PARTITION BY chrom ORDER BY node_id) AS BIGINT) AS block FROM cuts),
inner_ AS (SELECT src, dst, a.size AS src_size FROM edge JOIN blk a ON a.node_id = src JOIN blk b ON b.node_id = dst AND a.chrom = b.chrom AND a.block = b.block),
pre AS (SELECT node_id, CAST(0 AS BIGINT) AS d FROM blk UNION SELECT l.dst, p.d + l.src_size FROM pre p JOIN inner_ l ON l.src = p.node_id),
post AS (SELECT node_id, CAST(size AS BIGINT) AS d FROM blk WHERE node_id NOT IN (SELECT src FROM inner_) UNION SELECT l.src, p.d + l.src_size FROM post p JOIN inner_ l ON l.dst = p.node_id),
loc AS (SELECT blk.*, pre, post FROM blk JOIN (SELECT node_id, max(d) AS pre FROM pre GROUP BY 1) USING (node_id) JOIN (SELECT node_id, max(d) AS post FROM post GROUP BY 1) USING (node_id)),
spans AS (SELECT chrom, block, max(pre + post) AS span FROM loc GROUP BY ALL),
bases AS (SELECT chrom, block, span, sum(span) OVER (PARTITION BY chrom ORDER BY block) AS upto FROM spans),
lmap AS (SELECT chrom, node_id, size, CAST(upto - span + pre AS BIGINT) AS lin_start, CAST(upto - post + size AS BIGINT) AS lin_end FROM loc JOIN bases USING (chrom, block))"""

_KIND = "CASE WHEN a = node_index AND b = node_index + size THEN 'full' WHEN a = node_index THEN 'start' WHEN b = node_index + size THEN 'end' ELSE 'internal' END AS kind"


def segments_sql(name: str, runs: str) -> str:
    """CTEs that end in ``name``(chrom, node_id, size, node_index, a, b, kind, id): runs cut at the borders of nodes."""
    return f"""{name}_s AS (SELECT n.chrom, n.node_id, node_size AS size, node_index, greatest(start_pos, node_index) AS a, least(end_pos, node_index + node_size) AS b
  FROM {runs} r JOIN nodes n ON n.chrom = r.chrom AND start_pos < node_index + node_size AND node_index < end_pos),
{name}_k AS (SELECT *, {_KIND} FROM {name}_s),
{name} AS (SELECT *, node_id * 2 + CASE WHEN kind = 'end' THEN 1 ELSE 0 END AS id FROM {name}_k)"""


def holes_sql(name: str, runs: str, touched: str, longest: int) -> str:
    """CTEs that end in ``name``(chrom, start_pos, end_pos): runs with holes filled, also across nodes. They need edge."""
    h = f"{name}_h"
    return f"""{h}_g AS (SELECT chrom, end_pos AS start_pos, lead(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS end_pos FROM {runs} UNION ALL SELECT chrom, 0, min(start_pos) FROM {runs} GROUP BY chrom),
{h}_r AS (SELECT * FROM {h}_g WHERE end_pos IS NOT NULL AND start_pos < end_pos),
{segments_sql(h, f"{h}_r")},
{segments_sql(f"{name}_act", runs)},
{h}_seen AS (SELECT DISTINCT node_id FROM {touched}),
{h}_b AS (SELECT chrom, id, node_id, a, b, kind, b - a AS len FROM {h} WHERE kind <> 'internal'
  AND NOT (kind IN ('end', 'full') AND node_id NOT IN (SELECT src FROM edge)) AND NOT (kind IN ('start', 'full') AND node_id NOT IN (SELECT dst FROM edge))
  AND NOT (kind = 'full' AND node_id NOT IN (SELECT node_id FROM {h}_seen))),
{h}_in AS (SELECT dst AS node_id FROM edge WHERE src IN (SELECT node_id FROM {name}_act WHERE kind IN ('full', 'end')) AND src IN (SELECT node_id FROM {h}_seen)),
{h}_out AS (SELECT src AS node_id FROM edge WHERE dst IN (SELECT node_id FROM {name}_act WHERE kind IN ('full', 'start')) AND dst IN (SELECT node_id FROM {h}_seen)),
{h}_l AS (SELECT u.id AS u, u.len AS ul, v.id AS v, v.len AS vl FROM edge JOIN {h}_b u ON u.node_id = src AND u.kind IN ('full', 'end') JOIN {h}_b v ON v.node_id = dst AND v.kind IN ('full', 'start')),
{h}_fw AS (SELECT id, CAST(0 AS BIGINT) AS d FROM {h}_b WHERE kind = 'end' OR node_id IN (SELECT node_id FROM {h}_in) UNION SELECT v, d + ul FROM {h}_fw JOIN {h}_l ON u = id WHERE d + ul <= {longest}),
{h}_bw AS (SELECT id, CAST(len AS BIGINT) AS d FROM {h}_b WHERE kind = 'start' OR node_id IN (SELECT node_id FROM {h}_out) UNION SELECT u, d + ul FROM {h}_bw JOIN {h}_l ON v = id WHERE d + ul <= {longest}),
{h}_ok AS (SELECT f.id FROM (SELECT id, min(d) AS d FROM {h}_fw GROUP BY id) f JOIN (SELECT id, min(d) AS d FROM {h}_bw GROUP BY id) g ON f.id = g.id WHERE f.d + g.d <= {longest}),
{h}_all AS (SELECT chrom, start_pos, end_pos, true AS value FROM {runs} UNION ALL SELECT chrom, a, b, true FROM {h} WHERE kind = 'internal' AND b - a <= {longest}
  UNION ALL SELECT chrom, a, b, true FROM {h}_b WHERE id IN (SELECT id FROM {h}_ok)), {islands_sql(name, f"{h}_all")}"""


def paths_sql(name: str, runs: str, track: str) -> str:
    """CTEs that end in ``name``(chrom, start_off, end_off, region_paths, path_score, total_score, is_diff, is_ambiguous): every region's best path. They need edge."""
    r = f"{name}_r"
    return f"""{segments_sql(f"{r}_g", runs)},
{r}_v AS (SELECT g.chrom, g.node_id, g.a, g.b, sum(value * (least(g.b, end_pos) - greatest(g.a, start_pos))) AS score FROM {r}_g g JOIN {track} t ON t.chrom = g.chrom AND start_pos < g.b AND g.a < end_pos GROUP BY ALL),
{r}_seg AS (SELECT g.*, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM {r}_g g LEFT JOIN {r}_v v ON v.chrom = g.chrom AND v.node_id = g.node_id AND v.a = g.a AND v.b = g.b),
{r}_n AS (SELECT * FROM {r}_seg WHERE kind <> 'internal'),
{r}_l AS (SELECT u.id AS u, v.id AS v FROM edge JOIN {r}_n u ON u.node_id = src AND u.kind IN ('full', 'end') JOIN {r}_n v ON v.node_id = dst AND v.kind IN ('full', 'start')),
{r}_two AS (SELECT u, v FROM {r}_l UNION ALL SELECT v, u FROM {r}_l),
{r}_reach AS (SELECT id, id AS hit FROM {r}_n UNION SELECT q.id, t.v FROM {r}_reach q JOIN {r}_two t ON t.u = q.hit),
{r}_c AS (SELECT id, min(hit) AS component FROM {r}_reach GROUP BY id),
{r}_w AS (SELECT id AS at, [id] AS ids, [node_id] AS rp, score FROM {r}_n WHERE id NOT IN (SELECT v FROM {r}_l)
  UNION ALL SELECT n.id, list_prepend(n.id, ids), list_append(rp, n.node_id), w.score + n.score FROM {r}_w w JOIN {r}_l l ON l.u = w.at JOIN {r}_n n ON n.id = l.v),
{r}_e AS (SELECT component, ids, rp, w.score FROM {r}_w w JOIN {r}_c c ON c.id = w.at WHERE w.at NOT IN (SELECT u FROM {r}_l)),
{r}_best AS (SELECT *, count(*) OVER (PARTITION BY component) AS tied FROM (SELECT * FROM {r}_e QUALIFY score = max(score) OVER (PARTITION BY component))
  QUALIFY row_number() OVER (PARTITION BY component ORDER BY ids) = 1),
{r}_t AS (SELECT component, sum(score) AS total FROM {r}_n JOIN {r}_c USING (id) GROUP BY component),
{name} AS (SELECT f.chrom, CAST(f.a - f.node_index AS INT) AS start_off, CAST(z.b - z.node_index AS INT) AS end_off, rp AS region_paths, q.score AS path_score, total AS total_score, total <> q.score AS is_diff, tied > 1 AS is_ambiguous
  FROM {r}_best q JOIN {r}_t USING (component) JOIN {r}_n f ON f.id = ids[len(ids)] JOIN {r}_n z ON z.id = ids[1]
  UNION ALL SELECT chrom, CAST(a - node_index AS INT), CAST(b - node_index AS INT), [node_id], score, score, false, false FROM {r}_seg WHERE kind = 'internal')"""


def graph_background_sql(fragment: int, scale: int) -> str:
    """CTEs that end in lam_g(chrom, start_pos, end_pos, lam): the reads' background on the touched nodes. They need steps, lmap and ext."""
    half = scale // 2
    return f"""touched AS (SELECT DISTINCT n.node_id, n.node_index, n.node_index + n.node_size AS node_end FROM ext x JOIN nodes n ON n.chrom = x.chrom AND x.a < n.node_index + n.node_size AND n.node_index < x.b AND x.a < x.b),
begins AS (SELECT m.chrom, CAST(floor(lin_start + CASE WHEN node > 0 THEN lo ELSE hi END * CAST(lin_end - lin_start AS DOUBLE) / s.size) AS BIGINT) AS spot FROM steps s JOIN lmap m ON m.node_id = s.node_id WHERE i = 0),
least_ AS (SELECT (SELECT count(*) FROM begins) * {fragment} / (SELECT sum(l) FROM (SELECT max(lin_end) AS l FROM lmap GROUP BY chrom)) AS v),
lam_e AS (SELECT chrom, spot - {half} AS idx, 1 AS d FROM begins UNION ALL SELECT chrom, spot + {half}, -1 FROM begins),
lam_p AS (SELECT chrom, idx, sum(d) AS d FROM lam_e GROUP BY ALL HAVING sum(d) <> 0),
lam_r AS (SELECT chrom, idx AS start_pos, lead(idx) OVER w AS end_pos, sum(d) OVER w AS n FROM lam_p WINDOW w AS (PARTITION BY chrom ORDER BY idx)),
lam_l AS (SELECT chrom, start_pos, end_pos, greatest((SELECT v FROM least_), n / CAST({2 * half / fragment} AS DOUBLE)) AS lam FROM lam_r WHERE end_pos IS NOT NULL),
lam_h AS (SELECT m.chrom, t.node_index, t.node_end, lin_start, lin_end, start_pos AS s0, end_pos AS e0, lam, CAST(lin_end - lin_start AS DOUBLE) / m.size AS scale
  FROM touched t JOIN lmap m USING (node_id) JOIN lam_l l ON l.chrom = m.chrom AND start_pos < lin_end AND lin_start < end_pos),
lam_b AS (SELECT chrom, CAST(node_index + floor((greatest(lin_start, s0) - lin_start) / scale) AS BIGINT) AS start_pos,
  CAST(CASE WHEN e0 >= lin_end THEN node_end ELSE node_index + floor((e0 - lin_start) / scale) END AS BIGINT) AS end_pos, lam FROM lam_h),
lam_g AS (SELECT * FROM lam_b WHERE start_pos < end_pos)"""


def called_sql(extension: int, level: float, hole: int) -> str:
    """CTEs that end in called: p and q of pile over lam_g, regions, best paths on cover and their scores. They need ext, pile, cover, lam_g, least_ and edge."""
    tail = """CASE WHEN k >= lam THEN -(-lam + (ki + 1) * ln(lam) - lgamma(ki + 2)
    + ln(list_sum(list_transform(range(ki + 1, ki + 400), lambda i: exp((-lam + i * ln(lam) - lgamma(i + 1)) - (-lam + (ki + 1) * ln(lam) - lgamma(ki + 2))))))) / ln(10)
  ELSE -log10(1 - list_sum(list_transform(range(0, ki + 1), lambda i: exp(-lam + i * ln(lam) - lgamma(i + 1))))) END"""
    return f"""ev AS (SELECT chrom, start_pos AS idx, value AS v, CAST(0 AS DECIMAL(28, 9)) AS l FROM pile UNION ALL SELECT chrom, end_pos, -value, 0 FROM pile
  UNION ALL SELECT chrom, start_pos, 0, CAST(lam AS DECIMAL(28, 9)) FROM lam_g UNION ALL SELECT chrom, end_pos, 0, -CAST(lam AS DECIMAL(28, 9)) FROM lam_g),
pt AS (SELECT chrom, idx, sum(v) AS v, sum(l) AS l FROM ev GROUP BY ALL HAVING sum(v) <> 0 OR sum(l) <> 0),
rn AS (SELECT chrom, idx AS start_pos, lead(idx) OVER w AS end_pos, sum(v) OVER w AS k, sum(l) OVER w AS lam FROM pt WINDOW w AS (PARTITION BY chrom ORDER BY idx)),
pos AS (SELECT chrom, start_pos, end_pos, CAST(k AS DOUBLE) AS k, round(greatest(CAST(lam AS DOUBLE), (SELECT v FROM least_)), 6) AS lam FROM rn WHERE end_pos IS NOT NULL AND k > 0),
tails AS (SELECT k, lam, least(1000.0, {tail}) AS p FROM (SELECT DISTINCT k, lam, CAST(k AS BIGINT) AS ki FROM pos)),
pv AS (SELECT chrom, start_pos, end_pos, p FROM pos JOIN tails ON pos.k = tails.k AND pos.lam = tails.lam),
per AS (SELECT p, CAST(sum(end_pos - start_pos) AS BIGINT) AS bp FROM pv GROUP BY p),
raw AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS place, p + log10(1 + coalesce(sum(bp) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) - log10((SELECT sum(node_size) FROM nodes)) AS q FROM per),
qm AS (SELECT p, round(min(CASE WHEN place = 1 THEN greatest(q, 0) ELSE q END) OVER (ORDER BY p DESC), 6) AS q FROM raw),
qr AS (SELECT chrom, start_pos, end_pos, q FROM pv JOIN qm USING (p)),
hi AS (SELECT chrom, start_pos, end_pos, true AS value FROM qr WHERE q >= {level}), {islands_sql("sig", "hi")},
{holes_sql("filled", "sig", "touched", hole)},
{paths_sql("best", "filled", "cover")},
num AS (SELECT *, row_number() OVER () AS id FROM best),
walk AS (SELECT id, start_off, end_off, len(region_paths) AS n, unnest(range(len(region_paths))) AS i, unnest(region_paths) AS node_id FROM num),
rng AS (SELECT id, chrom, node_index + CASE WHEN i = 0 THEN start_off ELSE 0 END AS a, node_index + CASE WHEN i = n - 1 THEN end_off ELSE node_size END AS b FROM walk JOIN nodes USING (node_id)),
top AS (SELECT id, max(q) AS score FROM rng JOIN qr ON qr.chrom = rng.chrom AND start_pos < b AND a < end_pos AND a < b GROUP BY id),
called AS (SELECT chrom, start_off, end_off, region_paths, 1 AS direction, coalesce(score, 0) AS average_q_value, CAST(is_ambiguous AS INT) AS is_ambigous, CAST(is_diff AS INT) AS is_diff, bp
  FROM num JOIN (SELECT id, CAST(sum(b - a) AS BIGINT) AS bp FROM rng GROUP BY id) USING (id) LEFT JOIN top USING (id) WHERE bp >= {extension})"""
