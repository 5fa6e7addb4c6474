"""Validation of hits by ordered reasons, as two tables of bounds: kinds of geometry first, then the reasons that may except them."""

from pyspark.sql import functions as F

from tallyplan.operators import rules as R
from tallyplan.plans.base import query
from tallyplan.plans.rules import COLOR_CLASSES, COLOR_REASONS, measured, with_measured

# Bounds of the geometries that reasons except, in percent.
GEOMETRIES = R.read("""
interrupted_seed gray=1 interrupted=1 match>=45 area>=300 area<=3200 aspect<=325 coverage>=78 purity>=72 context>=28
near_seed gray=1 near=1 match>=52 coverage>=82 purity>=70 context>=26
diagonal_seed gray=1 text=1 from_content=1 slanted=1 match>=58 coverage>=95 purity>=20 context>=12
recovery gray=0 from_recovery=1 color>=90 scale>=90 area>=1100 area<=3800 aspect<=320 match>=52 coverage>=70 purity>=60 context>=18
recovery gray=0 from_recovery=1 color>=90 scale>=90 area>=900 area<=3800 aspect<=320 match>=46 coverage>=74 purity>=66 context>=30
wavy gray=0 text=0 inspected=1 area<=2600 aspect>=175 minor>38 match>=45 coverage>=80 purity>=52 context>=16
wide_content from_template=1 minor>=40 match>=66 coverage>=64 purity>=74
strong gray=1 match>=54 coverage>=94 purity>=40
strong gray=1 scale<=70 density<=35 aspect>=200 match>=54 coverage>=80 purity>=40 context>=12
strong gray=1 pixels>=1000 match>=52 coverage>=86 purity>=55 context>=30
strong gray=1 pixels>=700 match>=64 coverage>=96 purity>=60 context>=28
strong gray=1 scale>=75 aspect<200 match>=55 coverage>=67 purity>=70 context>=35
strong gray=1 scale>=75 match>=55 coverage>=82 purity>=70 context>=35
strong gray=1 text=0 slanted=1 scale>=80 match>=65 coverage>=88 purity>=30 context>=13
strong gray=1 text=0 slanted=1 scale>=80 match>=74 coverage>=88 purity>=30 context>=10
strong gray=1 text=1 slanted=1 area>=700 aspect<=220 match>=52 coverage>=72 purity>=68 context>=18
strong gray=1 text=1 from_content=1 slanted=1 match>=58 coverage>=95 purity>=20 context>=12
strong gray=1 near=1 area>=700 area<=5200 aspect<=320 match>=52 coverage>=82 purity>=70 context>=26
strong gray=1 text=1 near=1 scale>=70 area>=700 area<=5200 aspect<=320 match>=52 coverage>=68 purity>=88 context>=40
strong gray=1 text=1 near=1 scale>=70 area>=700 area<=5200 aspect<=320 match>=56 coverage>=86 purity>=74 context>=26
strong gray=1 interrupted=1 match>=45 area>=300 area<=3200 aspect<=325 coverage>=78 purity>=72 context>=28
strong gray=1 text=1 from_template=1 scale>=85 aspect>=180 match>=62 coverage>=88 purity>=74
strong gray=1 text=1 from_template=1 scale>=85 aspect>=180 area>=300 match>=60 coverage>=74 purity>=58 context>=14
strong gray=1 text=1 from_content=1 scale>=85 area>=300 match>=76 coverage>=93 purity>=34 context>=18
strong gray=1 text=1 from_content=1 scale>=85 area>=700 area<=5200 aspect<=320 match>=69 coverage>=84 purity>=28 context>=16
""")
#: Full and partial colour geometries are those of the classes of colour hits.
GEOMETRIES += [x._replace(name="full_shape", bounds=(*x.bounds, R.Bound("gray", "=", 0))) for x in COLOR_CLASSES if x.name in ("full_geometry", "full_text")]
GEOMETRIES += [x for x in COLOR_CLASSES if x.name == "strong_partial"]
# The reasons before and after those of colour hits, in order, with their bounds.
BEFORE = R.read("""
roi_shape roi_same=0
empty_roi foreground<=0
empty_roi pixels<=0
coverage coverage<24
purity purity<8
context_purity context<=0
""")
AFTER = R.read("""
noisy_partial context<36 coverage<67 purity<88
!noisy_partial strong_partial=1
!noisy_partial recovery=1
!noisy_partial wavy=1
gray_rect_frame_evidence gray=1 text=0 aspect>=200 density>=48 density<=70 frame_ok=0
gray_coverage gray=1 density<18 best_coverage<62
gray_purity gray=1 density<18 best_purity<30 context<55 diagonal_seed=0
gray_purity gray=1 density>=18 purity<18 context<45
gray_low_match gray=1 density<18 match<68 best_coverage<74
gray_small_scale_anomaly gray=1 scale<=70 coverage<80 purity>85
gray_small_scale_elongated_coverage gray=1 scale<=70 density<=35 aspect>=200 coverage<80
gray_elongated_low_match gray=1 scale<=70 density<=35 aspect>=200 match<54 interrupted_seed=0
gray_small_scale_compact_coverage gray=1 scale<=70 aspect<=135 coverage<82
gray_small_scale_high_purity_partial gray=1 scale<=90 coverage<90 purity>95 context<30
gray_tiny_fragment gray=1 text=0 near_seed=0 interrupted_seed=0 scale<=55 side<=22 context<45
gray_sparse_tiny_fragment gray=1 text=0 near_seed=0 interrupted_seed=0 scale<=75 side<=30 aspect>=115 density<=42 context<45
gray_large_scale_partial gray=1 scale>=100 coverage<65 purity>80 context>40
centroid shared<1
centroid_offset shifted>18
gray_diagonal_text_fragment gray=1 text=1 from_template=1 slanted=1 area>=700 aspect<=220
gray_diagonal_text_fragment gray=1 text=1 near=1 slanted=1 area>=700 aspect<=220
!gray_diagonal_text_fragment match>=66 coverage>=88 purity>=72 context>=34
!gray_diagonal_text_fragment match>=62 coverage>=90 purity>=82 context>=45
!gray_diagonal_text_fragment scale>=100 match>=60 coverage>=94 purity>=50 context>=26
gray_dark_evidence gray=1 strong=0 dark_pixels<10
gray_dark_evidence gray=1 strong=0 dark_coverage<62
low_match_strict match<58 context<72 strong=0 recovery=0 full_shape=0 wavy=0
content_score text=1 content<60
!content_score content>=50 wide_content=1
!content_score content>=40 full_shape=1
verification verification<400000 recovery=0 full_shape=0
""")
REASONS = BEFORE + COLOR_REASONS + AFTER


def inspected(spark, d):
    """Hits with all measures that the reasons read: some with little coverage or purity, wide ones, patches of another shape or without ink."""
    m = measured(spark, d)
    gray, source, q = F.col("gray"), F.col("source"), lambda c, n: F.floor(c / n)
    out = m.withColumns({
        "w": F.col("w") * (F.col("pixels") % 3 + 1), "coverage": F.when(F.col("major") % 11 == 0, F.col("coverage") - 30).otherwise(F.col("coverage")),
        "purity": F.when(F.col("variance") % 13 == 0, F.col("purity") - 28).otherwise(F.col("purity")), "content": F.col("content") - 20,
        "near": (source == 2).cast("long"), "interrupted": ((gray == 1) & (source == 4)).cast("long"), "inspected": ((gray == 0) & (source == 4)).cast("long"),
        "frame_ok": (F.col("ink_share") >= 40).cast("long"), "dark_coverage": F.col("major"), "dark_pixels": q(F.col("pixels") * F.col("major"), 100), "shifted": F.col("variance") % 25,
        "roi_same": (F.col("ink_share") % 59 != 7).cast("long"), "foreground": F.col("ink_share"),
    })
    w, h, core = F.col("w"), F.col("h"), 45 * F.col("match") + 20 * F.col("coverage") + 15 * F.col("purity") + 20 * F.col("context")
    out = out.withColumns({
        "area": w * h, "aspect": q(F.greatest(w, h) * 100, F.least(w, h)), "density": q(F.col("pixels") * 100, w * h), "side": q(F.greatest(w, h) * F.col("scale"), 100), "shared": q(F.col("pixels") * F.col("coverage"), 100),
        "best_coverage": F.greatest(F.col("coverage"), F.col("minor") + 20), "best_purity": F.greatest("purity", "minor"), "verification": F.when(F.col("text") == 1, 45 * core + 5500 * F.col("content")).otherwise(100 * core),
    })
    return out.withColumns({n: R.holds(GEOMETRIES, n).cast("long") for n in R.names(GEOMETRIES)})


_FLAGS = ", ".join(f"coalesce(max(CASE WHEN n.name = '{n}' THEN 1 END), 0) AS {n}" for n in R.names(GEOMETRIES))
INSPECTED = f"""i0 AS (SELECT * EXCLUDE (area, aspect) REPLACE (w * (pixels % 3 + 1) AS w, CASE WHEN major % 11 = 0 THEN coverage - 30 ELSE coverage END AS coverage, CASE WHEN variance % 13 = 0 THEN purity - 28 ELSE purity END AS purity, content - 20 AS content),
 source = 2 AS near, gray = 1 AND source = 4 AS interrupted, gray = 0 AND source = 4 AS inspected, ink_share >= 40 AS frame_ok, major AS dark_coverage, pixels * major // 100 AS dark_pixels, variance % 25 AS shifted, ink_share % 59 <> 7 AS roi_same, ink_share AS foreground FROM measured),
 i1 AS (SELECT *, w * h AS area, greatest(w, h) * 100 // least(w, h) AS aspect, pixels * 100 // (w * h) AS density, greatest(w, h) * scale // 100 AS side, pixels * coverage // 100 AS shared, greatest(coverage, minor + 20) AS best_coverage, greatest(purity, minor) AS best_purity,
 CASE WHEN text = 1 THEN 45 * (45 * match + 20 * coverage + 15 * purity + 20 * context) + 5500 * content ELSE 100 * (45 * match + 20 * coverage + 15 * purity + 20 * context) END AS verification FROM i0),
 inspected AS (SELECT * FROM i1 JOIN (WITH {R.sql(GEOMETRIES, 'i1', 'hit_id', _FLAGS)}) USING (hit_id))"""
_REASONS_SQL = R.sql(REASONS, "inspected", "hit_id", "arg_min(n.name, n.pos) AS reason")


@query("validation_reasons", with_measured(f"{INSPECTED}, {_REASONS_SQL}"))
def validation_reasons(spark, d):
    """The first of all reasons against a hit, gray and colour, or none."""
    return inspected(spark, d).select("hit_id", R.first(REASONS).alias("reason"))


@query("validation_reasons_by_source", with_measured(f"{INSPECTED}, reasons AS (WITH {_REASONS_SQL}) SELECT source, reason, count(*) AS n FROM reasons JOIN inspected USING (hit_id) GROUP BY ALL"))
def validation_reasons_by_source(spark, d):
    """How many hits of each source each reason stops, and how many none does."""
    return inspected(spark, d).groupBy("source", R.first(REASONS).alias("reason")).agg(F.count("*").alias("n"))
