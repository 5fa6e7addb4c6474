"""Raster queries over embeddings, taken as 8x8 patches."""

import numpy as np
from pyspark.sql import functions as F

from tallyplan.operators import raster as R
from tallyplan.plans.base import query, table


def patches(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("patch"), "label")


#: Fixed templates: a bar, a column, a diagonal and a frame.
TEMPLATES = [
    (1, [1.0 if k // 8 in (3, 4) else 0.0 for k in range(64)]),
    (2, [1.0 if k % 8 in (3, 4) else 0.0 for k in range(64)]),
    (3, [1.0 if k // 8 == k % 8 else 0.0 for k in range(64)]),
    (4, [1.0 if k // 8 in (0, 7) or k % 8 in (0, 7) else 0.0 for k in range(64)]),
]
_PIXELS = "px AS (SELECT vec_id, (k - 1) // 8 AS r, (k - 1) % 8 AS c, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings))"
_TEMPLATES = " UNION ALL ".join(f"SELECT {i} AS template_id, {t} AS t" for i, t in TEMPLATES)


@query(
    "patch_ncc_topk",
    f"""WITH {_PIXELS}, tp AS (SELECT template_id, (k - 1) // 8 AS r, (k - 1) % 8 AS c, CAST(v AS DOUBLE) AS v FROM (SELECT template_id, unnest(t) AS v, generate_subscripts(t, 1) AS k FROM ({_TEMPLATES}))),
 s AS (SELECT vec_id, template_id, corr(px.v, tp.v) AS score FROM px JOIN tp USING (r, c) GROUP BY vec_id, template_id)
 SELECT vec_id, template_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, template_id) AS k FROM s) WHERE k = 1""",
)
def patch_ncc_topk(spark, d):
    """The template that correlates best with each patch."""
    return R.best_templates(patches(spark, d), TEMPLATES).select("vec_id", "template_id", F.round("score", 6).alias("score"))


@query(
    "patch_mask_metrics",
    f"WITH {_PIXELS} SELECT vec_id, count(*) AS foreground, CAST(min(c) AS BIGINT) AS x, CAST(min(r) AS BIGINT) AS y, CAST(max(c) - min(c) + 1 AS BIGINT) AS w, CAST(max(r) - min(r) + 1 AS BIGINT) AS h, round(avg(c), 6) AS cx, round(avg(r), 6) AS cy, round(stddev_pop(c), 6) AS sx FROM px WHERE v > 0.05 GROUP BY vec_id",
)
def patch_mask_metrics(spark, d):
    """Foreground, bounds, centroid and spread of each patch's mask."""
    ink = R.pixels(patches(spark, d)).where("v > 0.05")
    return ink.groupBy("vec_id").agg(
        F.count("*").alias("foreground"), F.min("c").alias("x"), F.min("r").alias("y"), (F.max("c") - F.min("c") + 1).alias("w"), (F.max("r") - F.min("r") + 1).alias("h"), F.round(F.avg("c"), 6).alias("cx"), F.round(F.avg("r"), 6).alias("cy"), F.round(F.stddev_pop("c"), 6).alias("sx")
    )


@query(
    "patch_integral_sum",
    f"WITH {_PIXELS} SELECT vec_id, round(sum(CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 6 THEN v ELSE 0 END), 4) AS inside FROM px GROUP BY vec_id",
)
def patch_integral_sum(spark, d):
    """A rectangle's sum from four corners of the integral image."""

    def compute(values):
        image = np.zeros((len(values), R.SIDE + 1, R.SIDE + 1))
        image[:, 1:, 1:] = values.cumsum(axis=1).cumsum(axis=2)
        return R.every(len(values), image[:, 6, 7] - image[:, 2, 7] - image[:, 6, 1] + image[:, 2, 1])

    return R.patchwise(patches(spark, d), "vec_id long, inside double", compute).select("vec_id", F.round("inside", 4).alias("inside"))


@query(
    "mask_coverage_purity",
    f"WITH {_PIXELS}, n AS (SELECT a.vec_id, count(*) FILTER (WHERE a.v > 0.05 AND b.v > 0.05) AS inter, count(*) FILTER (WHERE a.v > 0.05) AS fa, count(*) FILTER (WHERE b.v > 0.05) AS fb FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.r = b.r AND a.c = b.c GROUP BY a.vec_id) SELECT vec_id, round(CAST(inter AS DOUBLE) / greatest(1, fa), 6) AS coverage, round(CAST(inter AS DOUBLE) / greatest(1, fb), 6) AS purity FROM n",
)
def mask_coverage_purity(spark, d):
    """How much of a patch's mask the next patch covers, and how much of that one it explains."""
    p = patches(spark, d)
    other = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("patch").alias("other"))
    n = p.join(other, "vec_id").select("vec_id", R.mask_counts(F.col("patch"), F.col("other"), 0.05).alias("n"))
    return n.select("vec_id", F.round(F.col("n.inter") / F.greatest(F.lit(1), "n.a"), 6).alias("coverage"), F.round(F.col("n.inter") / F.greatest(F.lit(1), "n.b"), 6).alias("purity"))


@query("ink_percentile_thresholds", f"WITH {_PIXELS} SELECT vec_id, round(least(0.2, greatest(0.01, quantile_cont(v, 0.75))), 6) AS anchor, round(quantile_cont(v, 0.5), 6) AS median FROM px GROUP BY vec_id")
def ink_percentile_thresholds(spark, d):
    rows = R.pixels(patches(spark, d))
    return rows.groupBy("vec_id").agg(F.round(F.least(F.lit(0.2), F.greatest(F.lit(0.01), F.percentile("v", F.lit(0.75)))), 6).alias("anchor"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("median"))


@query("ink_profile", f"WITH {_PIXELS} SELECT label, round(100.0 * count(*) FILTER (WHERE v > 0.1) / count(*), 4) AS dark, CASE WHEN count(*) FILTER (WHERE v > 0.1) * 100 < count(*) * 20 THEN 'gray' ELSE 'color' END AS profile FROM px JOIN embeddings USING (vec_id) GROUP BY label")
def ink_profile(spark, d):
    rows = R.pixels(patches(spark, d)).join(patches(spark, d).select("vec_id", "label"), "vec_id")
    return rows.groupBy("label").agg(F.round(F.count_if(F.col("v") > 0.1) * 100.0 / F.count("*"), 4).alias("dark"), F.when(F.count_if(F.col("v") > 0.1) * 100 < F.count("*") * 20, "gray").otherwise("color").alias("profile"))


@query("local_maxima", f"WITH {_PIXELS} SELECT a.vec_id, a.r, a.c FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE a.v >= 0.15 GROUP BY a.vec_id, a.r, a.c, a.v HAVING max(b.v) <= a.v")
def local_maxima(spark, d):
    """Pixels of at least .15 that no neighbour exceeds."""

    def compute(values):
        wide = np.pad(values, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
        at = np.argwhere((values >= 0.15) & (values >= R.windows(wide, 3).max(axis=(3, 4))))
        return at[:, 0], at[:, 1], at[:, 2]

    return R.patchwise(patches(spark, d), "vec_id long, r long, c long", compute)


INK = 0.05
_INK = f"{_PIXELS}, ink AS (SELECT vec_id, r, c FROM px WHERE v > {INK})"
#: Fixed small templates for scans: a cross and a corner.
SMALL = [(1, [[0, 1, 0], [1, 1, 1], [0, 1, 0]]), (2, [[1, 1, 1], [1, 0, 0], [1, 0, 0]])]
_SMALL = "tp(template_id, dr, dc, t) AS (VALUES " + ", ".join(f"({i}, {r}, {c}, {float(v)})" for i, t in SMALL for r, row in enumerate(t) for c, v in enumerate(row)) + ")"
_PLACES = f"{_PIXELS}, {_SMALL}, w AS (SELECT vec_id, template_id, r - dr AS r, c - dc AS c, v, t FROM px CROSS JOIN tp WHERE r - dr BETWEEN 0 AND 5 AND c - dc BETWEEN 0 AND 5)"
_BEST = "SELECT vec_id, template_id, r, c, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, template_id ORDER BY score DESC, r, c) AS k FROM s) WHERE k = 1"


def _scan(spark, d, masked):
    def compute(values):
        out = []
        for i, t in SMALL:
            t = np.array(t, dtype=np.float64)
            scores = np.round(R.scan_scores(values, t, (t > 0).astype(float) if masked else None), 6)
            best = scores.reshape(len(values), -1).argmax(axis=1)
            out.append((np.arange(len(values)), np.full(len(values), i), best // scores.shape[2], best % scores.shape[2], scores.reshape(len(values), -1)[np.arange(len(values)), best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return R.patchwise(patches(spark, d), "vec_id long, template_id long, r long, c long, score double", compute)


@query("template_scan", f"WITH {_PLACES}, s AS (SELECT vec_id, template_id, r, c, round(corr(v, t), 6) AS score FROM w GROUP BY ALL) {_BEST}")
def template_scan(spark, d):
    """Where each small template correlates best with a patch."""
    return _scan(spark, d, False)


@query("masked_template_scan", f"WITH {_PLACES}, s AS (SELECT vec_id, template_id, r, c, round(sum(v * t) / sqrt(sum(v * v) * sum(t * t)), 6) AS score FROM w WHERE t > 0 GROUP BY ALL) {_BEST}")
def masked_template_scan(spark, d):
    """The same under the template's mask, without centring."""
    return _scan(spark, d, True)


def _counts(spark, d, schema, compute):
    return R.patchwise(patches(spark, d), schema, lambda values: R.every(len(values), *compute(values > INK)))


def _number(masks):
    return masks.sum(axis=(1, 2))


@query("dilated_masks", f"WITH {_INK} SELECT vec_id, (SELECT count(*) FROM ink i WHERE i.vec_id = e.vec_id) AS before, (SELECT count(*) FROM px p WHERE p.vec_id = e.vec_id AND EXISTS (SELECT 1 FROM ink i WHERE i.vec_id = p.vec_id AND abs(i.r - p.r) <= 1 AND abs(i.c - p.c) <= 1)) AS after FROM embeddings e")
def dilated_masks(spark, d):
    return _counts(spark, d, "vec_id long, before long, after long", lambda m: (_number(m), _number(R.dilated(m))))


@query("opened_masks", f"WITH {_INK}, kept AS (SELECT p.vec_id, p.r, p.c FROM px p WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.vec_id = p.vec_id AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 AND q.v <= {INK})) SELECT vec_id, (SELECT count(*) FROM px p WHERE p.vec_id = e.vec_id AND EXISTS (SELECT 1 FROM kept i WHERE i.vec_id = p.vec_id AND abs(i.r - p.r) <= 1 AND abs(i.c - p.c) <= 1)) AS opened FROM embeddings e")
def opened_masks(spark, d):
    """Masks without what is thinner than three pixels."""
    return _counts(spark, d, "vec_id long, opened long", lambda m: (_number(R.dilated(R.eroded(m))),))


_RUNS = f"{_INK}, runs AS (SELECT vec_id, r, min(c) AS c0, count(*) AS n FROM (SELECT *, c - row_number() OVER (PARTITION BY vec_id, r ORDER BY c) AS g FROM ink) GROUP BY vec_id, r, g)"


@query("long_strokes_suppressed", f"WITH {_RUNS} SELECT e.vec_id, CAST(coalesce(sum(n) FILTER (WHERE n < 3), 0) AS BIGINT) AS left_, coalesce(max(n), 0) AS longest FROM embeddings e LEFT JOIN runs USING (vec_id) GROUP BY e.vec_id")
def long_strokes_suppressed(spark, d):
    """Ink outside of horizontal strokes of three pixels and more, and the longest stroke."""

    def compute(masks):
        runs = R.run_lengths(masks)
        return ((runs > 0) & (runs < 3)).sum(axis=(1, 2)), runs.max(axis=(1, 2))

    return _counts(spark, d, "vec_id long, left_ long, longest long", compute)


_COMPONENTS = f"""{_INK}, reach(vec_id, node, seen) AS (SELECT vec_id, r * 8 + c, r * 8 + c FROM ink UNION SELECT q.vec_id, q.node, i.r * 8 + i.c FROM reach q JOIN ink i ON i.vec_id = q.vec_id AND abs(i.r - q.seen // 8) <= 1 AND abs(i.c - q.seen % 8) <= 1),
 part AS (SELECT vec_id, node, min(seen) AS component FROM reach GROUP BY vec_id, node), comps AS (SELECT vec_id, component, count(*) AS pixels, min(node // 8) AS r, min(node % 8) AS c, max(node // 8) - min(node // 8) + 1 AS rows_, max(node % 8) - min(node % 8) + 1 AS columns_ FROM part GROUP BY vec_id, component)"""


def _components(spark, d):
    return R.patchwise(patches(spark, d), "vec_id long, component long, pixels long, r long, c long, rows_ long, columns_ long", lambda values: R.components(values > INK))


@query("mask_components", f"WITH RECURSIVE {_COMPONENTS} SELECT * FROM comps")
def mask_components(spark, d):
    """Connected ink of each patch: size and bounds."""
    return _components(spark, d)


@query(
    "search_regions",
    f"WITH RECURSIVE {_COMPONENTS}, b AS (SELECT vec_id, greatest(0, r - 1) AS r0, greatest(0, c - 1) AS c0, least(8, r + rows_ + 1) AS r1, least(8, c + columns_ + 1) AS c1 FROM comps WHERE pixels >= 2) SELECT DISTINCT vec_id, CASE WHEN whole THEN 0 ELSE r0 END AS r0, CASE WHEN whole THEN 0 ELSE c0 END AS c0, CASE WHEN whole THEN 8 ELSE r1 END AS r1, CASE WHEN whole THEN 8 ELSE c1 END AS c1 FROM (SELECT *, bool_or((r1 - r0) * (c1 - c0) * 10 >= 64 * 7) OVER (PARTITION BY vec_id) AS whole FROM b)",
)
def search_regions(spark, d):
    """Padded bounds of components as regions to scan; the whole patch where one covers seven tenths of it."""
    side = F.lit(R.SIDE)
    b = _components(spark, d).where("pixels >= 2").select("vec_id", F.greatest(F.lit(0), F.col("r") - 1).alias("r0"), F.greatest(F.lit(0), F.col("c") - 1).alias("c0"), F.least(side, F.col("r") + F.col("rows_") + 1).alias("r1"), F.least(side, F.col("c") + F.col("columns_") + 1).alias("c1"))
    whole = b.groupBy("vec_id").agg(F.bool_or((F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")) * 10 >= R.SIDE * R.SIDE * 7).alias("whole"))
    pick = lambda c, v: F.when(F.col("whole"), v).otherwise(F.col(c)).cast("long").alias(c)
    return b.join(whole, "vec_id").select("vec_id", pick("r0", 0), pick("c0", 0), pick("r1", R.SIDE), pick("c1", R.SIDE)).distinct()


@query("tile_regions", f"WITH {_INK} SELECT vec_id, r // 4 AS tr, c // 4 AS tc, count(*) AS n FROM ink GROUP BY ALL HAVING count(*) >= 6")
def tile_regions(spark, d):
    """Coarse tiles with enough ink to be scanned."""

    def compute(values):
        n = (values > INK).reshape(len(values), 2, 4, 2, 4).sum(axis=(2, 4))
        at = np.argwhere(n >= 6)
        return at[:, 0], at[:, 1], at[:, 2], n[tuple(at.T)]

    return R.patchwise(patches(spark, d), "vec_id long, tr long, tc long, n long", compute)


@query("gray_scan_masks", f"WITH {_PIXELS} SELECT vec_id, count(*) FILTER (WHERE v > 0.02) AS zone, count(*) FILTER (WHERE v > 0.08) AS evidence, count(*) FILTER (WHERE v > 0.15) AS dark FROM px GROUP BY vec_id")
def gray_scan_masks(spark, d):
    """Ink at the three thresholds of gray scans."""
    return R.patchwise(patches(spark, d), "vec_id long, zone long, evidence long, dark long", lambda v: R.every(len(v), *((v > t).sum(axis=(1, 2)) for t in (0.02, 0.08, 0.15))))


_PLACE = np.arange(1, 65).reshape(8, 8)


@query(
    "variant_transforms",
    f"""WITH {_INK}, v(quarter, mirrored) AS (SELECT q.quarter, m.mirrored FROM (VALUES (0), (1), (2), (3)) q(quarter) CROSS JOIN (VALUES (0), (1)) m(mirrored)), a AS (SELECT vec_id, quarter, mirrored, r, CASE WHEN mirrored = 1 THEN 7 - c ELSE c END AS c FROM ink CROSS JOIN v)
 SELECT vec_id, quarter, mirrored, CAST(sum(CASE quarter WHEN 0 THEN r * 8 + c WHEN 1 THEN c * 8 + 7 - r WHEN 2 THEN (7 - r) * 8 + 7 - c ELSE (7 - c) * 8 + r END + 1) AS BIGINT) AS digest FROM a GROUP BY ALL""",
)
def variant_transforms(spark, d):
    """A template's variants: mirrored and turned by quarters, as the sum of the places of their ink."""

    def compute(values):
        rows = [(np.arange(len(values)), np.full(len(values), q), np.full(len(values), m), (R.turned(values > INK, q, bool(m)) * _PLACE).sum(axis=(1, 2))) for q in range(4) for m in range(2)]
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True))

    return R.patchwise(patches(spark, d), "vec_id long, quarter long, mirrored long, digest long", compute).where("digest > 0")


@query("resized_masks", f"WITH {_INK}, s(side) AS (VALUES (4), (6), (12)), g AS (SELECT side, r.i AS r, c.i AS c FROM s CROSS JOIN range(12) r(i) CROSS JOIN range(12) c(i) WHERE r.i < side AND c.i < side) SELECT vec_id, side, CAST(sum(g.r * side + g.c + 1) AS BIGINT) AS digest FROM g JOIN ink ON ink.r = g.r * 8 // side AND ink.c = g.c * 8 // side GROUP BY vec_id, side")
def resized_masks(spark, d):
    """Variants at other scales, each pixel from the nearest."""

    def compute(values):
        rows = [(np.arange(len(values)), np.full(len(values), n), (R.nearest(values > INK, n) * np.arange(1, n * n + 1).reshape(n, n)).sum(axis=(1, 2))) for n in (4, 6, 12)]
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True))

    return R.patchwise(patches(spark, d), "vec_id long, side long, digest long", compute).where("digest > 0")


_HSV = f"{_PIXELS}, hsv AS (SELECT vec_id, r, c, CAST(floor(abs(v) * 1000) AS BIGINT) % 180 AS h, CAST(floor(abs(v) * 7000) AS BIGINT) % 256 AS s, CAST(floor(abs(v) * 5000) AS BIGINT) % 256 AS val FROM px)"


def _hsv(values):
    return tuple(np.floor(np.abs(values) * k).astype(np.int64) % n for k, n in ((1000, 180), (7000, 256), (5000, 256)))


@query("hue_masks", f"WITH {_HSV}, h AS (SELECT vec_id, h, s, val, (label * 17) % 180 AS want FROM hsv JOIN embeddings USING (vec_id)) SELECT vec_id, count(*) FILTER (WHERE s >= 30 AND val >= 50) AS coloured, count(*) FILTER (WHERE s >= 30 AND val >= 50 AND least(abs(h - want), 180 - abs(h - want)) <= 18) AS matching FROM h GROUP BY vec_id")
def hue_masks(spark, d):
    """Coloured pixels, and those within a tolerance of the template's hue, around the circle."""

    def compute(values, label):
        h, s, v = _hsv(values)
        coloured = (s >= 30) & (v >= 50)
        far = np.abs(h - (label.astype(np.int64) * 17 % 180)[:, None, None])
        return R.every(len(values), coloured.sum(axis=(1, 2)), (coloured & (np.minimum(far, 180 - far) <= 18)).sum(axis=(1, 2)))

    return R.patchwise(patches(spark, d), "vec_id long, coloured long, matching long", compute, "label")


@query("median_hsv", f"WITH {_HSV} SELECT vec_id, CAST(trunc(quantile_cont(h, 0.5)) AS BIGINT) AS h, CAST(trunc(quantile_cont(s, 0.5)) AS BIGINT) AS s, CAST(trunc(quantile_cont(val, 0.5)) AS BIGINT) AS v FROM hsv WHERE s >= 30 AND val >= 50 GROUP BY vec_id")
def median_hsv(spark, d):
    """The middle hue, saturation and value of the coloured pixels."""

    def compute(values):
        h, s, v = _hsv(values)
        coloured = (s >= 30) & (v >= 50)
        some = np.flatnonzero(coloured.any(axis=(1, 2)))
        return some, *(np.trunc(np.nanmedian(np.where(coloured, x, np.nan)[some], axis=(1, 2))).astype(np.int64) for x in (h, s, v))

    return R.patchwise(patches(spark, d), "vec_id long, h long, s long, v long", compute)


@query("context_purity", f"WITH {_PIXELS} SELECT vec_id, round(CAST(count(*) FILTER (WHERE v > {INK} AND r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE v > {INK})), 6) AS purity FROM px GROUP BY vec_id")
def context_purity(spark, d):
    """The share of the ink around a place that is in its inner part."""
    return _counts(spark, d, "vec_id long, purity double", lambda m: (np.round(_number(m[:, 2:6, 2:6]) / np.maximum(1, _number(m)), 6),))


@query("edge_bands", f"WITH {_PIXELS} SELECT vec_id, count(*) FILTER (WHERE v > {INK} AND r < 2) AS top, count(*) FILTER (WHERE v > {INK} AND r > 5) AS bottom, count(*) FILTER (WHERE v > {INK} AND c < 2) AS near, count(*) FILTER (WHERE v > {INK} AND c > 5) AS far, count(*) FILTER (WHERE v > {INK} AND r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5) AS centre FROM px GROUP BY vec_id")
def edge_bands(spark, d):
    """Ink in the four bands along the edges, and in the centre."""
    return _counts(spark, d, "vec_id long, top long, bottom long, near long, far long, centre long", lambda m: tuple(_number(x) for x in (m[:, :2], m[:, 6:], m[:, :, :2], m[:, :, 6:], m[:, 2:6, 2:6])))


@query("frame_evidence", f"WITH {_RUNS}, cols AS (SELECT vec_id, c, count(*) AS n FROM ink GROUP BY vec_id, c) SELECT e.vec_id, coalesce(max(n) FILTER (WHERE r = 0), 0) AS top_run, coalesce(max(n) FILTER (WHERE r = 7), 0) AS bottom_run, coalesce((SELECT max(n) FROM cols k WHERE k.vec_id = e.vec_id AND k.c IN (0, 7)), 0) AS side FROM embeddings e LEFT JOIN runs USING (vec_id) GROUP BY e.vec_id")
def frame_evidence(spark, d):
    """Evidence for a frame: the longest strokes along top and bottom, and the fuller side."""

    def compute(masks):
        runs = R.run_lengths(masks)
        return runs[:, 0].max(axis=1), runs[:, 7].max(axis=1), masks[:, :, [0, 7]].sum(axis=1).max(axis=1)

    return _counts(spark, d, "vec_id long, top_run long, bottom_run long, side long", compute)


@query("content_scores", f"WITH {_PIXELS}, n AS (SELECT a.vec_id, count(*) FILTER (WHERE a.v > {INK} AND b.v > {INK}) AS i, count(*) FILTER (WHERE a.v > {INK}) AS fa, count(*) FILTER (WHERE b.v > {INK}) AS fb FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.r = b.r AND a.c = b.c GROUP BY a.vec_id) SELECT vec_id, round(0.6 * i / greatest(1, fa) + 0.4 * i / greatest(1, fb), 6) AS score FROM n")
def content_scores(spark, d):
    """How well a label's glyphs are covered and explained: three to two."""
    p = patches(spark, d)
    n = p.join(p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("patch").alias("other")), "vec_id").select("vec_id", R.mask_counts(F.col("patch"), F.col("other"), INK).alias("n"))
    return n.select("vec_id", F.round(0.6 * F.col("n.inter") / F.greatest(F.lit(1), "n.a") + 0.4 * F.col("n.inter") / F.greatest(F.lit(1), "n.b"), 6).alias("score"))


@query("side_arrows", f"WITH {_INK} SELECT vec_id, max(r) - min(r) + 1 AS span, count(*) AS weight FROM ink WHERE c >= 5 GROUP BY vec_id")
def side_arrows(spark, d):
    """The rows that ink in the right band spans, and its weight."""

    def compute(values):
        band = values[:, :, 5:] > INK
        rows = band.any(axis=2)
        some = np.flatnonzero(rows.any(axis=1))
        first, last = rows.argmax(axis=1), R.SIDE - 1 - rows[:, ::-1].argmax(axis=1)
        return some, (last - first + 1)[some], band.sum(axis=(1, 2))[some]

    return R.patchwise(patches(spark, d), "vec_id long, span long, weight long", compute)


@query(
    "table_gutters",
    f"WITH {_PIXELS}, cols AS (SELECT vec_id, c, count(*) FILTER (WHERE v > {INK}) AS n FROM px GROUP BY vec_id, c), runs AS (SELECT vec_id, min(c) AS start, count(*) AS width FROM (SELECT *, c - row_number() OVER (PARTITION BY vec_id ORDER BY c) AS g FROM cols WHERE n <= 2) GROUP BY vec_id, g) SELECT vec_id, start, width FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY width DESC, start) AS k FROM runs) WHERE k = 1",
)
def table_gutters(spark, d):
    """The widest run of columns with hardly any ink: the gap between a table's columns."""

    def compute(values):
        bare = ((values > INK).sum(axis=1) <= 2)[:, None, :]
        runs = R.run_lengths(bare)[:, 0]
        some = np.flatnonzero(runs.any(axis=1))
        return some, runs.argmax(axis=1)[some], runs.max(axis=1)[some]

    return R.patchwise(patches(spark, d), "vec_id long, start long, width long", compute)


@query("separator_columns", f"WITH {_INK} SELECT e.vec_id, coalesce(min(c) FILTER (WHERE n >= 5), 1) AS separator FROM embeddings e LEFT JOIN (SELECT vec_id, c, count(*) AS n FROM ink WHERE c BETWEEN 1 AND 4 GROUP BY vec_id, c) USING (vec_id) GROUP BY e.vec_id")
def separator_columns(spark, d):
    """The first column of the allowed band that is a line, else the usual place."""

    def compute(masks):
        line = masks[:, :, 1:5].sum(axis=1) >= 5
        return (np.where(line.any(axis=1), line.argmax(axis=1) + 1, 1),)

    return _counts(spark, d, "vec_id long, separator long", compute)


@query("left_color_scores", f"WITH {_HSV} SELECT vec_id, count(*) FILTER (WHERE s >= 30 AND val >= 50 AND c < 3) AS score FROM hsv GROUP BY vec_id")
def left_color_scores(spark, d):
    """Coloured pixels in the left part of a row, where its symbol is."""

    def compute(values):
        _, s, v = _hsv(values)
        return R.every(len(values), ((s >= 30) & (v >= 50))[:, :, :3].sum(axis=(1, 2)))

    return R.patchwise(patches(spark, d), "vec_id long, score long", compute)


@query("ink_crops", f"WITH {_INK}, b AS (SELECT vec_id, min(r) AS r0, min(c) AS c0, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM ink GROUP BY vec_id) SELECT vec_id, h, w, CAST(sum((r - r0) * w + c - c0 + 1) AS BIGINT) AS digest FROM ink JOIN b USING (vec_id) GROUP BY ALL")
def ink_crops(spark, d):
    """A symbol cut out with its ink alone: size, and the sum of the places of its ink in the cut."""

    def compute(values):
        m = values > INK
        some = np.flatnonzero(m.any(axis=(1, 2)))
        m = m[some]
        rows, columns = m.any(axis=2), m.any(axis=1)
        r0, c0 = rows.argmax(axis=1), columns.argmax(axis=1)
        h, w = R.SIDE - rows[:, ::-1].argmax(axis=1) - r0, R.SIDE - columns[:, ::-1].argmax(axis=1) - c0
        r, c = np.arange(R.SIDE)[None, :, None], np.arange(R.SIDE)[None, None, :]
        place = (r - r0[:, None, None]) * w[:, None, None] + c - c0[:, None, None] + 1
        return some, h, w, (m * place).sum(axis=(1, 2))

    return R.patchwise(patches(spark, d), "vec_id long, h long, w long, digest long", compute)
