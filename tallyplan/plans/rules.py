"""Classes, reject reasons and scan policies of measured hits, by tables of bounds in percent."""

from pyspark.sql import functions as F

from tallyplan.operators import rules as R
from tallyplan.plans.base import hits, query, with_hits

# The bounds of the classes of gray hits.
GRAY_CLASSES = R.read("""
complex gray=1 text=0 pixels>=1000 match>=52 verif>=57 coverage>=86 purity>=55 context>=30
mid gray=1 text=0 pixels>=700 match>=64 verif>=64 coverage>=96 purity>=60 context>=28
tiny gray=1 text=0 pixels<=360 scale<=55 match>=59 verif>=58 coverage>=98 purity>=50 context>=23
strong_label gray=1 text=1 pixels>=1000 match>=74 verif>=68 coverage>=88 purity>=70 context>=44
raw_rescue gray=1 text=0 pixels>=1000 match>=52
raw_rescue gray=1 text=0 pixels>=700 match>=64
raw_rescue gray=1 text=1 pixels>=1000 match>=74
raw_rescue gray=1 scale<=70 match>=54
geometry_rescue gray=1 scale<=70 match>=54 coverage>=94 purity>=40 verif>=60
full_label gray=1 text=1 scale>=85 area>=1000 aspect>=135 coverage>=88 purity>=34 content>=70 verif>=66 from_template=1 match>=62
full_label gray=1 text=1 scale>=85 area>=1000 aspect>=135 coverage>=88 purity>=34 content>=82 verif>=66 from_content=1 match>=70
full_label gray=1 text=1 scale>=85 area>=1000 aspect>=135 coverage>=94 purity>=36 content>=70 verif>=70 from_content=1 context>=18
tiny_text gray=1 text=1 from_template=1 scale<=55 longest<=26 context<=30 match<=62 verif<=76
weak_label gray=1 text=1 context<=23 purity<=58
!weak_label match>=68 verif>=60 coverage>=94 purity>=48
!weak_label from_content=1 scale>=85 match>=72 verif>=74 coverage>=95 content>=82
!weak_label from_content=1 scale>=85 area>=1000 aspect>=130 verif>=70 coverage>=94 purity>=32 context>=18
!weak_label from_template=1 scale>=85 area>=1000 match>=60 verif>=60 coverage>=90 purity>=50 context>=18
!weak_label from_content=1 scale>=85 area>=1000 match>=69 verif>=68 coverage>=84 purity>=28 context>=16 content>=76
!weak_label from_content=1 slanted=1 scale>=85 area>=1000 match>=58 verif>=66 coverage>=95 content>=74 context>=14
""")
# The reasons to reject a colour hit, in order, with their bounds.
COLOR_REASONS = R.read("""
color_recovery_tiny_fragment gray=0 from_recovery=1 area<1000 match<45 coverage<70
color_recovery_isolated_fragment gray=0 from_recovery=1
!color_recovery_isolated_fragment color>=90 scale>=90 area>=1100 area<=3800 aspect<=320 match>=52 coverage>=70 purity>=60 context>=18
!color_recovery_isolated_fragment color>=90 scale>=90 area>=900 area<=3800 aspect<=320 match>=46 coverage>=74 purity>=66 context>=30
color_text_fragment gray=0 text=1 content_pixels>0 content_ratio<=18 sideways=1 match<60
color_text_fragment gray=0 text=1 content_pixels>0 content_ratio<=18 match<50 coverage<78 context<45
color_similarity gray=0 from_pdf=0 color<68
color_straight_stroke_fragment gray=0 text=0 scanned=1 area<=2600 aspect>=175 major>=52 minor<=30 match<72
color_flat_elongated_fragment gray=0 text=0 scanned=1 area<=2600 aspect>=175 major>=88 minor<=62 variance<=35 match<70
color_content_fragment gray=0 text=1 from_content=1 match<62
color_content_fragment gray=0 text=1 from_content=1 coverage<68
color_content_fragment gray=0 text=1 from_content=1 purity<72
color_content_fragment gray=0 text=1 from_content=1 context<48
color_text_geometry gray=0 text=1 direct=1 coverage<62
color_text_geometry gray=0 text=1 direct=1 purity<68
color_text_geometry gray=0 text=1 direct=1 context<30
color_text_weak_match gray=0 text=1 direct=1 match<55 context<45
color_elongated_stroke_fragment gray=0 text=0 direct=1 area<=2600 aspect>=175 match<56
color_elongated_stroke_fragment gray=0 text=0 direct=1 area<=2600 aspect>=175 purity<62
color_elongated_stroke_fragment gray=0 text=0 direct=1 area<=2600 aspect>=175 context<25 match<68
""")
# The bounds of the classes of colour hits.
COLOR_CLASSES = R.read("""
compact_satellite gray=0 from_pdf=0 area>=700 area<=2200 aspect<=185 match>=62 verif>=62 coverage>=70 purity>=72
full_geometry gray=0 full_source=1 color>=90 scale>=90 area>=900 area<=3800 aspect<=320 match>=50 coverage>=60 purity>=58 context>=18
full_geometry gray=0 full_source=1 from_recovery=0 color>=90 scale>=90 area>=1250 area<=3800 aspect<=235 match>=40 coverage>=58 purity>=50 context>=16
full_text text=1 full_source=1 scale>=90 area>=900 area<=3800 aspect<=320 match>=50 coverage>=70 purity>=75 context>=45
strong_partial gray=0 color>=90 match>=60 coverage>=56 purity>=75 context>=28
""")
# Which scans beyond the first a variant gets in a region.
SCANS = R.read("""
content text=1 content_pixels>=180 content_ratio<100
near_gray gray=1 area>=700 area<=5200 region_area<=80000 aspect<=320 ink_share>=45
interrupted gray=1 text=1 mirrored=0 area>=300 area<=3200 region_area<=80000 aspect<=325 ink_share>=40
near_color gray=0 scale>=90 area>=500 area<=3400 region_area<=650000 aspect<=320 ink_share>=1
diagonal gray=1 text=1 slanted=1 region_area>=1
diagonal gray=1 text=0 slanted=1 scale>=80 aspect>=200 pixels<=1200
""")
#: Scans that are off unless asked for.
OFF = ("interrupted",)
# The thresholds of gray scans in hundredths, by the first line that fits.
THRESHOLDS = R.read("""
t52 text=0 pixels>=1000
t30 text=0 aspect>=200 pixels<=800
t57 pixels>=0
""")
# Variants that aren't worth a scan.
PRUNED = R.read("""
tiny gray=1 text=0 scale<=55 longest<=22
""")

SOURCES = ("template", "template_content", "template_near_threshold", "template_color_recovery", "roi_inspector", "pdf_text")


def measured(spark, d):
    """Hits with their measures, shares in percent."""
    part, okey, line, w, h = (F.col(c) for c in ("part", "okey", "line", "w", "h"))
    out = hits(spark, d).select(
        "hit_id", "plan_id", "template_id", "x", "y", "w", "h", F.col("match_pct").alias("match"), F.col("verif_pct").alias("verif"), (40 + (part * 7 + line * 13) % 61).alias("coverage"), (30 + (part * 11 + okey * 3) % 71).alias("purity"),
        ((part * 5 + line * 19) % 70).alias("context"), (50 + (okey * 7 + part) % 51).alias("content"), (60 + (part * 3 + okey) % 41).alias("color"), (50 + 10 * (okey % 8)).alias("scale"), (45 * (part % 8)).alias("rotation"),
        (100 + (part * 37 + line * 11) % 1500).alias("pixels"), (part % 3 == 0).cast("long").alias("text"), (okey % 2 == 0).cast("long").alias("gray"), ((part + line) % 6).alias("source"), (line % 2).alias("mirrored"),
        (40 + (okey * 3 + line) % 61).alias("major"), (10 + (part + okey) % 60).alias("minor"), ((okey * 11 + part) % 80).alias("variance"), ((part * 13 + line) % 120).alias("ink_share"), (w * h).alias("area"),
        F.floor(F.greatest(w, h) * 100 / F.least(w, h)).alias("aspect"), ((w + 40 * line) * (h + 40 * line)).alias("region_area"),
    )
    source = F.col("source")
    flags = {"from_template": source == 0, "from_content": source == 1, "from_recovery": source == 3, "from_pdf": source == 5, "direct": source.isin(0, 2), "scanned": source.isin(0, 2, 3, 4), "full_source": source.isin(0, 3, 4), "slanted": F.col("rotation") % 90 != 0, "sideways": F.col("rotation") % 180 == 90}
    out = out.withColumns({k: v.cast("long") for k, v in flags.items()})
    return out.withColumns({"longest": F.floor(F.greatest("w", "h") * F.col("scale") / 100), "content_ratio": F.col("content") - 40, "content_pixels": F.floor(F.col("pixels") * (F.col("content") - 40) / 100)})


MEASURED = """, m0 AS (SELECT hit_id, plan_id, template_id, x, y, w, h, match_pct AS match, verif_pct AS verif, 40 + (part * 7 + line * 13) % 61 AS coverage, 30 + (part * 11 + okey * 3) % 71 AS purity, (part * 5 + line * 19) % 70 AS context,
 50 + (okey * 7 + part) % 51 AS content, 60 + (part * 3 + okey) % 41 AS color, 50 + 10 * (okey % 8) AS scale, 45 * (part % 8) AS rotation, 100 + (part * 37 + line * 11) % 1500 AS pixels, CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS text,
 CASE WHEN okey % 2 = 0 THEN 1 ELSE 0 END AS gray, (part + line) % 6 AS source, line % 2 AS mirrored, 40 + (okey * 3 + line) % 61 AS major, 10 + (part + okey) % 60 AS minor, (okey * 11 + part) % 80 AS variance, (part * 13 + line) % 120 AS ink_share,
 w * h AS area, greatest(w, h) * 100 // least(w, h) AS aspect, (w + 40 * line) * (h + 40 * line) AS region_area FROM hits),
 measured AS (SELECT *, source = 0 AS from_template, source = 1 AS from_content, source = 3 AS from_recovery, source = 5 AS from_pdf, source IN (0, 2) AS direct, source IN (0, 2, 3, 4) AS scanned, source IN (0, 3, 4) AS full_source,
 rotation % 90 <> 0 AS slanted, rotation % 180 = 90 AS sideways, greatest(w, h) * scale // 100 AS longest, content - 40 AS content_ratio, pixels * (content - 40) // 100 AS content_pixels FROM m0)"""


def with_measured(body: str) -> str:
    return with_hits(f"{MEASURED}, {body}")


_LIST = "coalesce(string_agg(n.name, ',' ORDER BY n.pos), '') AS classes"


@query("gray_hit_classes", with_measured(R.sql(GRAY_CLASSES, "measured", "hit_id", _LIST)))
def gray_hit_classes(spark, d):
    """The classes of each hit: geometry, labels, rescues and fragments."""
    return measured(spark, d).select("hit_id", R.all_names(GRAY_CLASSES).alias("classes"))


@query("color_hit_classes", with_measured(R.sql(COLOR_CLASSES, "measured", "hit_id", _LIST)))
def color_hit_classes(spark, d):
    return measured(spark, d).select("hit_id", R.all_names(COLOR_CLASSES).alias("classes"))


@query("color_reject_reason", with_measured(R.sql(COLOR_REASONS, "measured", "hit_id", "arg_min(n.name, n.pos) AS reason")))
def color_reject_reason(spark, d):
    """The first of ten ordered reasons against a colour hit, or none."""
    return measured(spark, d).select("hit_id", R.first(COLOR_REASONS).alias("reason"))


@query("scan_eligibility", with_measured(R.sql([x for x in SCANS if x.name not in OFF], "measured", "hit_id", _LIST)))
def scan_eligibility(spark, d):
    return measured(spark, d).select("hit_id", R.all_names([x for x in SCANS if x.name not in OFF]).alias("classes"))


@query("gray_scan_threshold", with_measured(R.sql(THRESHOLDS, "measured", "hit_id", "CAST(substr(arg_min(n.name, n.pos), 2) AS BIGINT) AS threshold")))
def gray_scan_threshold(spark, d):
    return measured(spark, d).select("hit_id", F.substring(R.first(THRESHOLDS), 2, 9).cast("long").alias("threshold"))


@query("variants_scanned", with_measured("kept AS (SELECT template_id, scale, mirrored FROM measured WHERE NOT (gray = 1 AND text = 0 AND scale <= 55 AND longest <= 22)) SELECT template_id, scale, mirrored, count(*) AS n FROM kept GROUP BY ALL"))
def variants_scanned(spark, d):
    """Variants that are left once the tiny ones are pruned."""
    return measured(spark, d).where(~R.holds(PRUNED, "tiny")).groupBy("template_id", "scale", "mirrored").agg(F.count("*").alias("n"))


def _reasons_sql() -> str:
    body = R.sql(COLOR_REASONS, "measured", "hit_id", "any_value(r.source) AS source, arg_min(n.name, n.pos) AS reason")
    head, tail = body.rsplit(" SELECT r.hit_id", 1)
    return with_measured(f"{head}, reasons AS (SELECT r.hit_id{tail}) SELECT source, reason, count(*) AS n FROM reasons GROUP BY ALL")


@query("color_reasons_by_source", _reasons_sql())
def color_reasons_by_source(spark, d):
    """How many hits of each source each reason stops."""
    return measured(spark, d).groupBy("source", R.first(COLOR_REASONS).alias("reason")).agg(F.count("*").alias("n"))


@query("core_scores", with_measured("s AS (SELECT hit_id, text, 45 * match + 20 * coverage + 15 * purity + 20 * context AS core, content FROM measured) SELECT hit_id, CASE WHEN text = 1 THEN 45 * core + 5500 * content ELSE 100 * core END AS millionths FROM s"))
def core_scores(spark, d):
    """A hit's verification: match, coverage, purity and context weighed; labels also by their content."""
    core = 45 * F.col("match") + 20 * F.col("coverage") + 15 * F.col("purity") + 20 * F.col("context")
    return measured(spark, d).select("hit_id", F.when(F.col("text") == 1, 45 * core + 5500 * F.col("content")).otherwise(100 * core).alias("millionths"))


@query("quality_ranks", with_measured("q AS (SELECT hit_id, verif / 100.0 + match / 100.0 + context / 100.0 + 0.7 * purity / 100.0 + least(0.45, ln(1 + area) * 0.05) AS score FROM measured) SELECT hit_id, round(score, 6) AS score FROM q"))
def quality_ranks(spark, d):
    """The score by which alternatives of one place are ranked, with a bonus for area."""
    score = (F.col("verif") + F.col("match") + F.col("context") + 0.7 * F.col("purity")) / 100.0 + F.least(F.lit(0.45), F.log1p("area") * 0.05)
    return measured(spark, d).select("hit_id", F.round(score, 6).alias("score"))
