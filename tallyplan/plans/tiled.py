"""Queries over whole plans in tiles: template peaks, components, regions, lines, lattices, promotions, turned masks."""

import numpy as np
from pyspark.sql import functions as F

from tallyplan.operators import lines as L
from tallyplan.operators import masks as M
from tallyplan.operators import raster as R
from tallyplan.operators import regions as G
from tallyplan.operators import tiles as T
from tallyplan.operators import variants as V
from tallyplan.plans import drawn as D
from tallyplan.plans.base import query, table

THRESHOLD = 0.7
#: The variants that are looked for: template and quarter.
WANTED = [(0, 0), (1, 0), (2, 0), (2, 1)]
_VARIANTS = [(t, 90 * q, D.TURNED[t, q]) for t, q in WANTED]
_SIZES = ", ".join(f"({t}, {turn}, {m.shape[0]}, {m.shape[1]}, {int(m.sum())}, {T.peak_radius(m.shape[0])}, {T.peak_radius(m.shape[1])})" for t, turn, m in _VARIANTS)
_WANTED = " OR ".join(f"(t = {t} AND q = {q})" for t, q in WANTED)


@query(
    "plan_template_peaks",
    f"""WITH {D.INK}, size(t, turn, h, w, n, up, across) AS (VALUES {_SIZES}),
 met AS (SELECT plan_id, t, q * 90 AS turn, r - dr AS r, c - dc AS c, count(*) AS common FROM ink, (SELECT * FROM glyphs WHERE {_WANTED}) GROUP BY ALL),
 near AS (SELECT m.*, h, w, n, up, across FROM met m JOIN size USING (t, turn) WHERE common * 100 >= n * 40 AND r >= 0 AND c >= 0 AND r + h <= {D.SIZE} AND c + w <= {D.SIZE}),
 before AS (SELECT p AS plan_id, r.i AS r, c.i AS c, coalesce(sum(k.one) OVER (PARTITION BY p, r.i ORDER BY c.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
  FROM (SELECT DISTINCT plan_id AS p FROM ink), range({D.SIZE}) r(i), range({D.SIZE + 1}) c(i) LEFT JOIN (SELECT *, 1 AS one FROM ink) k ON k.plan_id = p AND k.r = r.i AND k.c = c.i),
 under AS (SELECT a.plan_id, a.t, a.turn, a.r, a.c, sum(y.n - x.n) AS ink FROM (SELECT *, unnest(range(r, r + h)) AS row_ FROM near) a JOIN before x ON x.plan_id = a.plan_id AND x.r = row_ AND x.c = a.c JOIN before y ON y.plan_id = a.plan_id AND y.r = row_ AND y.c = a.c + a.w GROUP BY ALL),
 scored AS (SELECT *, (h * w * common - ink * n) / sqrt(CAST((h * w * ink - ink * ink) * (h * w * n - n * n) AS DOUBLE)) AS score FROM near JOIN under USING (plan_id, t, turn, r, c)),
 good AS (SELECT * FROM scored WHERE score >= {THRESHOLD})
 SELECT plan_id, CAST(t AS BIGINT) AS template_id, turn, c AS x, r AS y, w, h, common, round(score, 9) AS score FROM good a
 WHERE NOT EXISTS (SELECT 1 FROM good b WHERE b.plan_id = a.plan_id AND b.t = a.t AND b.turn = a.turn AND abs(b.r - a.r) <= a.up AND abs(b.c - a.c) <= a.across AND a.score < b.score - 1e-6)""",
)
def plan_template_peaks(spark, d):
    """Where the symbols correlate best with whole plans, at every place."""
    return T.template_peaks(D.plans(spark, d), _VARIANTS, THRESHOLD).withColumn("score", F.round("score", 9))


#: Every component's first run has none above it, so labels start from such runs alone.
_COMPONENTS = f"""{D.INK}, runs AS (SELECT plan_id, r, min(c) AS c0, max(c) AS c1, plan_id * {1 << 40} + r * {1 << 20} + min(c) AS id FROM (SELECT *, c - row_number() OVER (PARTITION BY plan_id, r ORDER BY c) AS g FROM ink) GROUP BY plan_id, r, g),
 below AS (SELECT a.id AS a, b.id AS b FROM runs a JOIN runs b ON b.plan_id = a.plan_id AND b.r = a.r + 1 AND b.c0 <= a.c1 + 1 AND a.c0 <= b.c1 + 1),
 met AS (SELECT a, b FROM below UNION ALL SELECT b, a FROM below),
 reach(seed, node) AS (SELECT id, id FROM runs WHERE id NOT IN (SELECT b FROM below) UNION SELECT seed, b FROM reach JOIN met ON a = node),
 part AS (SELECT node AS id, min(seed) AS component FROM reach GROUP BY node)"""


@query(
    "plan_components",
    f"WITH RECURSIVE {_COMPONENTS} SELECT plan_id, component, CAST(sum(c1 - c0 + 1) AS BIGINT) AS pixels, min(c0) AS x, min(r) AS y, max(c1) - min(c0) + 1 AS w, max(r) - min(r) + 1 AS h, CAST(sum((c0 + c1) * (c1 - c0 + 1)) // 2 AS BIGINT) AS sum_x, CAST(sum(r * (c1 - c0 + 1)) AS BIGINT) AS sum_y FROM runs JOIN part USING (id) GROUP BY plan_id, component",
)
def plan_components(spark, d):
    """Connected ink of whole plans: pixels, bounds and sums of places."""
    return T.components(D.plans(spark, d)).drop("rows", "columns")


@query("plan_search_regions")
def plan_search_regions(spark, d):
    """Windows to search around the symbols of each plan."""
    return G.search_regions(D.plans(spark, d, strokes=False), 12, 12)


@query("plan_gray_regions")
def plan_gray_regions(spark, d):
    """Windows to search on gray plans: components, tiles of large ones, a fair share of every cell, and a supplement."""
    out = G.gray_regions(D.plans(spark, d), 30, 22, supplement=40)
    return out.withColumn("score", F.round("score", 9))


def _lines_sql(name: str, across: str, along: str) -> str:
    """Lines of one direction: ``along`` it and ``across`` it."""
    return f"""{name}_islands AS (SELECT plan_id, {across} AS r, min({along}) AS c0, max({along}) + 1 AS c1 FROM (SELECT *, {along} - row_number() OVER (PARTITION BY plan_id, {across} ORDER BY {along}) AS g FROM ink) GROUP BY plan_id, {across}, g HAVING count(*) >= {L.LONG}),
 {name}_closed AS (SELECT plan_id, r, min(c0) AS c0, max(c1) AS c1, plan_id * {1 << 40} + r * {1 << 20} + min(c0) AS id FROM (SELECT *, sum(new) OVER (PARTITION BY plan_id, r ORDER BY c0) AS k FROM (SELECT *, CASE WHEN c0 - lag(c1) OVER (PARTITION BY plan_id, r ORDER BY c0) <= {L.GAP} THEN 0 ELSE 1 END AS new FROM {name}_islands)) GROUP BY plan_id, r, k),
 {name}_met AS (SELECT a.id AS a, b.id AS b FROM {name}_closed a JOIN {name}_closed b ON a.plan_id = b.plan_id AND abs(a.r - b.r) = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
 {name}_reach(node, seen) AS (SELECT id, id FROM {name}_closed UNION SELECT q.node, e.b FROM {name}_reach q JOIN {name}_met e ON q.seen = e.a),
 {name}_lines AS (SELECT plan_id, line, min(c0) AS a0, max(c1) - min(c0) AS length, min(r) AS b0, max(r) - min(r) + 1 AS thick FROM {name}_closed JOIN (SELECT node, min(seen) AS line FROM {name}_reach GROUP BY node) ON node = id GROUP BY plan_id, line)"""


_LINES = f"{D.INK}, {_lines_sql('h', 'r', 'c')}, {_lines_sql('v', 'c', 'r')}"


@query("plan_lines", f"WITH RECURSIVE {_LINES} SELECT plan_id, 'horizontal' AS direction, a0 AS x, b0 AS y, length AS w, thick AS h FROM h_lines UNION ALL SELECT plan_id, 'vertical', b0, a0, thick, length FROM v_lines")
def plan_lines(spark, d):
    """Long lines of whole plans in both directions, over the borders of tiles."""
    plans = D.plans(spark, d)
    named = lambda df, direction: df.select("plan_id", F.lit(direction).alias("direction"), *"xywh")
    return named(L.horizontal_lines(plans), "horizontal").unionByName(named(L.vertical_lines(plans), "vertical"))


#: Lines of strokes have gaps of a block, so lattices are made of lines with these closed, and of those of one stroke.
_LOOSE_LONG, _LOOSE_GAP = 16, 17
_LATTICE = _LINES.replace(f">= {L.LONG}", f">= {_LOOSE_LONG}").replace(f"<= {L.GAP}", f"<= {_LOOSE_GAP}")
_CROSSED = f"""crossed AS (SELECT plan_id, h.line AS h_line, v.line AS v_line, v.b0 + v.thick // 2 AS x, h.b0 + h.thick // 2 AS y, h.a0 AS h0, h.a0 + h.length AS h1, v.a0 AS v0, v.a0 + v.length AS v1 FROM h_lines h JOIN v_lines v USING (plan_id) WHERE h.a0 - 5 < v.b0 + v.thick AND v.b0 < h.a0 + h.length + 5 AND h.b0 - 5 < v.a0 + v.length AND v.a0 < h.b0 + h.thick + 5),
 arms AS (SELECT *, x - h0 >= 8 AS left_, h1 - x >= 8 AS right_, y - v0 >= 8 AS up, v1 - y >= 8 AS down FROM crossed)"""


@query(
    "plan_lattice_cells",
    f"""WITH RECURSIVE {_LATTICE}, {_CROSSED}, east AS (SELECT a.plan_id, a.h_line, a.v_line, a.x, a.y, arg_min(b.v_line, (b.x, b.v_line)) AS v2, min(b.x) AS x2, arg_min(b.left_, (b.x, b.v_line)) AS ok FROM arms a JOIN arms b ON a.plan_id = b.plan_id AND a.h_line = b.h_line AND (b.x, b.v_line) > (a.x, a.v_line) AND b.down WHERE a.down AND a.right_ GROUP BY ALL),
 south AS (SELECT a.plan_id, a.h_line, a.v_line, arg_min(b.h_line, (b.y, b.h_line)) AS h2, min(b.y) AS y2, arg_min(b.up, (b.y, b.h_line)) AS ok FROM arms a JOIN arms b ON a.plan_id = b.plan_id AND a.v_line = b.v_line AND (b.y, b.h_line) > (a.y, a.h_line) AND b.right_ WHERE a.right_ GROUP BY ALL)
 SELECT e.plan_id, e.x, e.y, x2 - e.x AS w, y2 - e.y AS h FROM east e JOIN south s USING (plan_id, h_line, v_line) JOIN arms z ON z.plan_id = e.plan_id AND z.h_line = h2 AND z.v_line = v2 AND z.up AND z.left_ WHERE e.ok AND s.ok AND x2 > e.x AND y2 > e.y""",
)
def plan_lattice_cells(spark, d):
    """Cells between the lines of whole plans."""
    plans = D.plans(spark, d)
    h, v = L.horizontal_lines(plans, _LOOSE_LONG, _LOOSE_GAP), L.vertical_lines(plans, _LOOSE_LONG, _LOOSE_GAP)
    return L.lattice_cells(L.crossings(h, v))


def _promotions() -> list[M.Promotion]:
    children = V.variants(0, D.SYMBOLS[0], scales=(100,), mirror=False)
    parents = V.variants(2, D.SYMBOLS[2], scales=(100,), mirror=False)
    return M.rules(children, parents, extra=60, radius=4, any_turn=False, least_context=10, drop=30)


@query("plan_promotions")
def plan_promotions(spark, d):
    """Frames found on whole plans, made armed frames where the arm's pixels are there."""
    plans = D.plans(spark, d)
    frames = [(0, 90 * q, D.TURNED[0, q]) for q in range(2)]
    hits = T.template_peaks(plans, frames, 0.6)
    hits = hits.select(
        F.concat_ws("-", "plan_id", "template_id", "turn", "x", "y").alias("id"), "plan_id", "template_id", F.lit(100).alias("scale"), "turn", F.lit(False).alias("mirrored"), "x", "y", "w", "h", F.col("score").alias("verification")
    )
    out = M.promote(plans, hits, _promotions())
    return out.select("id", "plan_id", "template_id", "turn", *"xywh", "promoted_from", *(F.round(c, 9).alias(c) for c in ("verification", "extra", "coverage", "purity", "context")))


_ANGLES = [a for a in sorted({*V.SLANTED, *V.SLANTED_LABELS})]
_FRAMES = ", ".join(f"({a}, {V.frame(R.SIDE, R.SIDE, a)[0]}, {V.frame(R.SIDE, R.SIDE, a)[1]})" for a in _ANGLES)
_NEAREST = "CAST(floor(floor(({0}) * 1024 + 0.5) / 1024 + 0.5) AS BIGINT)"


@query(
    "turned_masks",
    f"""WITH px AS (SELECT vec_id, (k - 1) // 8 AS r, (k - 1) % 8 AS c FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) WHERE v > 0.05),
 a(degrees, rows_, columns_) AS (VALUES {_FRAMES}), g AS (SELECT *, y.i AS y, x.i AS x, cos(radians(degrees)) AS co, sin(radians(degrees)) AS si FROM a, range(16) y(i), range(16) x(i) WHERE y.i < rows_ AND x.i < columns_),
 seen AS (SELECT degrees, rows_, columns_, y, x, {_NEAREST.format('co * (y - rows_ / 2) - si * (x - columns_ / 2) + 4')} AS r, {_NEAREST.format('co * (x - columns_ / 2) + si * (y - rows_ / 2) + 4')} AS c FROM g)
 SELECT vec_id, CAST(degrees AS BIGINT) AS degrees, CAST(rows_ AS BIGINT) AS rows_, CAST(columns_ AS BIGINT) AS columns_, count(*) AS ink, CAST(sum(y * columns_ + x + 1) AS BIGINT) AS digest FROM px JOIN seen USING (r, c) GROUP BY ALL""",
)
def turned_masks(spark, d):
    """Patches turned by the slanted angles, as the sum of the places of their ink."""

    def compute(values):
        rows = []
        for degrees in _ANGLES:
            h, w = V.frame(R.SIDE, R.SIDE, degrees)
            r, c = V.sampled(R.SIDE, R.SIDE, degrees)
            inside = (r >= 0) & (r < R.SIDE) & (c >= 0) & (c < R.SIDE)
            ink = np.zeros((len(values), h, w), dtype=bool)
            ink[:, inside] = (values > 0.05)[:, r[inside], c[inside]]
            some = np.flatnonzero(ink.any(axis=(1, 2)))
            constant = lambda v, n=len(some): np.full(n, v)
            rows.append((some, constant(degrees), constant(h), constant(w), ink[some].sum(axis=(1, 2)), (ink[some] * np.arange(1, h * w + 1).reshape(h, w)).sum(axis=(1, 2))))
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True))

    patches = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("patch"))
    return R.patchwise(patches, "vec_id long, degrees long, rows_ long, columns_ long, ink long, digest long", compute)
