"""Conflicts among colour symbols: the chain of stages over final hits, and its stages one by one."""

from pyspark.sql import functions as F

from tallyplan.operators import conflicts as C, rules as R
from tallyplan.plans.base import D2, INTER, WITHIN, query
from tallyplan.plans.rules import COLOR_REASONS, SOURCES, measured, with_measured

#: Names and hues of the 29 symbols of the derived hits; one has no hue.
NAMES = [
    "00_AW1", "01_L1", "02_L2", "03_L3", "04_L4", "05_L5", "06_L6", "07_L7", "08_L8", "09_L9", "10_L10", "11_L11", "12_L12", "13_L13", "01_sym_01", "02_sym_02", "03_sym_03", "04_sym_04",
    "05_sym_05", "19_EW1", "20_EW2", "21_PEL1", "22_PEL2A", "23_PELX-PP", "24_K1", "25_K2", "26_N", "27_TB11", "28_TB11",
]
HUES = [30, *([5] * 13), *([150] * 5), 60, 60, 100, 100, 110, 20, 20, None, 2, 2]
#: Symbols that crowd.
CROWDED = (*range(7, 14), *range(20, 24), 27, 28)
FLOOR_BOX = (23, NAMES[23], HUES[23])
#: Sources as far as they tell hits from text apart.
SOURCE = [s if s != "roi_inspector" else "template" for s in SOURCES]


def colored(spark, d):
    """Hits with the names, hues and shapes of their symbols: long ones, waves and panels are wider. Symbols that take part in
    conflicts crowd in a corner of their plan, and a third of all hits have ``lost`` their place to another hit."""
    at = lambda values, c: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(c) + 1).cast("int"))
    long, panel, wave = F.col("name").isin(*C.LONG), F.col("template_id") == 27, F.col("template_id") == 28
    out = measured(spark, d).withColumns({"name": at(NAMES, "template_id"), "hue": at(HUES, "template_id").cast("long"), "quarter": F.col("pixels") % 4})
    crowded = F.col("template_id").isin(*CROWDED)
    out = out.withColumns({"w": F.col("w") * F.when(long | panel, 3).when(wave, 2).otherwise(1), "x": F.when(crowded, F.floor(F.col("x") / 4)).otherwise(F.col("x")), "y": F.when(crowded, F.floor(F.col("y") / 4)).otherwise(F.col("y")), "h": F.when(long, F.col("h") % 8 + 32).when(panel, F.col("h") * 3).otherwise(F.col("h"))})
    out = out.withColumns({"area": F.col("w") * F.col("h"), "aspect": F.floor(F.greatest("w", "h") * 100 / F.least("w", "h")), "visual_h": F.when(F.col("quarter") == 0, F.floor(F.col("h") / 2)).otherwise(F.col("h"))})
    stroke = F.coalesce(R.first(COLOR_REASONS) == "color_elongated_stroke_fragment", F.lit(False))
    out = out.withColumns({"stroke": stroke, "source": at(SOURCE, "source"), "content": F.when(F.col("text") == 1, F.col("content")).otherwise(0), "id": F.col("hit_id"), "lost": F.col("ink_share") % 3 == 0})
    return out.select("plan_id", *(F.col(c).cast("long").alias(c) if c in ("template_id", "hue", "x", "y", "w", "h", "visual_h", *C.MEASURES) else c for c in (*C.HIT, "lost")))


def finals(hits):
    return C.as_finals(hits.where((F.col("verif") >= 58) & ~F.col("lost") & (F.col("source") != C.TEXT)))


def words(hits):
    """Hits from text, by the token that their symbol's name has."""
    return hits.where(F.col("source") == C.TEXT).select("plan_id", "x", "y", "w", "h", F.regexp_replace(F.regexp_extract("name", r"^\d+_(.*)$", 1), "[^A-Z0-9]", "").alias("token"))


def _listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_LONG = "(" + ", ".join(f"'{n}'" for n in C.LONG) + ")"
_TAKEN = "template_id, name, x, y, w, h, hue, visual_h, match, coverage, purity, content"
COLORED = f"""c0 AS (SELECT hit_id AS id, plan_id, template_id, {_listed(NAMES)}[template_id + 1] AS name, {_listed(HUES)}[template_id + 1] AS hue, CASE WHEN template_id IN {CROWDED} THEN x // 4 ELSE x END AS x, CASE WHEN template_id IN {CROWDED} THEN y // 4 ELSE y END AS y, w AS w0, h AS h0, {_listed(SOURCE)}[source + 1] AS source,
 match, verif, coverage, purity, context, CASE WHEN text = 1 THEN content ELSE 0 END AS content, pixels % 4 AS quarter, ink_share % 3 = 0 AS lost FROM measured),
 c1 AS (SELECT * EXCLUDE (w0, h0), w0 * CASE WHEN name IN {_LONG} OR template_id = 27 THEN 3 WHEN template_id = 28 THEN 2 ELSE 1 END AS w, CASE WHEN name IN {_LONG} THEN h0 % 8 + 32 WHEN template_id = 27 THEN h0 * 3 ELSE h0 END AS h FROM c0),
 colored AS (SELECT *, CASE WHEN quarter = 0 THEN h // 2 ELSE h END AS visual_h FROM c1),
 finals AS (SELECT *, id AS place FROM colored WHERE verif >= 58 AND NOT lost AND source <> 'pdf_text'),
 words AS (SELECT plan_id, x, y, w, h, regexp_replace(regexp_extract(name, '^[0-9]+_(.*)$', 1), '[^A-Z0-9]', '', 'g') AS token FROM colored WHERE source = 'pdf_text')"""


def with_colored(body: str) -> str:
    return with_measured(f"{COLORED}, {body}")


def shares(percent: int) -> str:
    return f"({INTER} * 100 >= least(a.w*a.h, b.w*b.h) * {percent})"


def staged(stage, spark, d, *more):
    hits = colored(spark, d)
    return stage(finals(hits), hits, words(hits), *more)


_OUT = "place, id AS hit_id, template_id, source, verif, context"
_SCORE = "(30 * {0}.verif + 14 * {0}.match + 9 * {0}.coverage + 5 * {0}.purity + 5 * {0}.context)"
_LEFT = "SELECT place, id AS hit_id, template_id, source, verif, context FROM finals a WHERE NOT EXISTS ({})"


def shown(state):
    return state.select("place", F.col("id").alias("hit_id"), "template_id", "source", "verif", "context")


@query(
    "family_reclasses",
    with_colored(f"""f AS (SELECT * FROM finals WHERE regexp_matches(name, '^[0-9]+_sym_[0-9]+') AND hue BETWEEN 135 AND 165),
 p AS (SELECT * FROM colored WHERE source <> 'pdf_text' AND regexp_matches(name, '^[0-9]+_sym_[0-9]+') AND hue BETWEEN 135 AND 165 AND coverage >= 50 AND purity >= 55 AND context >= 20),
 near AS (SELECT a.place, b.*, {_SCORE.format('b')} AS score FROM f a JOIN p b ON a.plan_id = b.plan_id WHERE {INTER} > 0 AND ({shares(55)} OR ({D2} * 10000 <= 4 * pow(greatest(2400, 48 * least(a.w, a.h, b.w, b.h)), 2) AND {shares(22)}) OR (({WITHIN.format('a', 'b')} OR {WITHIN.format('b', 'a')}) AND {shares(35)}))),
 best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, id) = 1),
 won AS (SELECT b.* FROM best b JOIN f ON f.place = b.place WHERE b.score > {_SCORE.format('f')} + 120 AND NOT (b.template_id = f.template_id AND b.x = f.x AND b.y = f.y AND b.w = f.w AND b.h = f.h))
 SELECT place, id AS hit_id, template_id, 'template_family_reclass' AS source, greatest(verif, 58) AS verif, greatest(context, 24) AS context FROM won UNION ALL SELECT {_OUT} FROM finals WHERE place NOT IN (SELECT place FROM won)"""),
)
def family_reclasses(spark, d):
    """Final hits once places of the family went to clearly better siblings."""
    return shown(staged(C.reclass_family, spark, d))


_LOCAL = f"""pool AS (SELECT * FROM colored WHERE name IN {_LONG} AND source <> 'pdf_text' AND match >= 60 AND coverage >= 68 AND purity >= 70 AND context >= 35 AND greatest(w, h) * 100 >= least(w, h) * 245 AND least(w, h) >= 32),
 local AS (SELECT a.place, b.* FROM finals a JOIN pool b ON a.plan_id = b.plan_id WHERE a.name LIKE '28!_TB11%' ESCAPE '!' AND {INTER} > 0 AND ({shares(40)} OR ({D2} <= 4 * 42 * 42 AND {shares(20)}))
 AND (b.match >= a.match + 6 OR (b.match >= 62 AND b.coverage >= 73 AND b.purity >= 72 AND a.context <= 32)) QUALIFY row_number() OVER (PARTITION BY a.place ORDER BY b.match DESC, b.coverage DESC, b.purity DESC, b.context DESC, b.verif DESC, b.id) = 1),
 promoted AS (SELECT place, id, plan_id, 'template_long_l_rescue' AS source, greatest(verif, 58) AS verif, greatest(context, 24) AS context, {_TAKEN} FROM local
 UNION ALL SELECT place, id, plan_id, source, verif, context, {_TAKEN} FROM finals WHERE place NOT IN (SELECT place FROM local))"""


@query("long_promotions", with_colored(f"{_LOCAL} SELECT {_OUT} FROM promoted"))
def long_promotions(spark, d):
    """Final hits once waves handed their place to stronger long symbols."""
    return shown(staged(C.promote_long, spark, d))


@query(
    "waves_against_long",
    with_colored(f"""rivals AS (SELECT * FROM colored WHERE source <> 'pdf_text' AND name IN {_LONG} AND match >= 56 AND coverage >= 55 AND purity >= 62)
 {_LEFT.format(f"SELECT 1 FROM rivals b WHERE a.name LIKE '28!_TB11%' ESCAPE '!' AND a.plan_id = b.plan_id AND ({shares(8)} OR {D2} <= 4 * 86 * 86) AND b.match >= greatest(56, a.match + 4)")}"""),
)
def waves_against_long(spark, d):
    """Final hits without the waves near a long symbol that matches better."""
    return shown(staged(C.drop_waves, spark, d))


@query(
    "floor_boxes",
    with_colored("""named AS (SELECT DISTINCT a.place FROM finals a JOIN words b ON a.plan_id = b.plan_id WHERE regexp_full_match(a.name, '[0-9]+_PEL[0-9]+[A-Z]?') AND regexp_full_match(b.token, 'PEL.*PP')
 AND 2*b.x + b.w BETWEEN 2 * (a.x - round_even(greatest(70, a.w * 0.75), 0)) AND 2 * (a.x + a.w + round_even(greatest(70, a.w * 0.75), 0)) AND 2*b.y + b.h BETWEEN 2 * (a.y - round_even(greatest(34, a.h * 0.55), 0)) AND 2 * (a.y + a.h + round_even(greatest(34, a.h * 0.55), 0)))
 SELECT place, id AS hit_id, CASE WHEN place IN (SELECT place FROM named) THEN 23 ELSE template_id END AS template_id, CASE WHEN place IN (SELECT place FROM named) THEN 'template_label_disambiguation' ELSE source END AS source, verif, context FROM finals"""),
)
def floor_boxes(spark, d):
    """Final hits once labelled symbols became floor boxes by a word next to them."""
    return shown(staged(C.relabel_floor_boxes, spark, d, FLOOR_BOX))


_GAP = "greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w))"
_COMMON = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))"


@query(
    "rescued_long_near_waves",
    with_colored(f"""{_LOCAL}, waves AS (SELECT * FROM promoted WHERE name LIKE '28!_TB11%' ESCAPE '!' AND source <> 'pdf_text' AND match >= 50 AND verif >= 50 AND coverage >= 75 AND purity >= 52),
 rescued AS (SELECT * FROM promoted WHERE source = 'template_long_l_rescue' AND name IN {_LONG} AND plan_id IN (SELECT plan_id FROM waves)),
 by_waves AS (SELECT a.place, count(*) AS n FROM rescued a JOIN waves b ON a.plan_id = b.plan_id WHERE ({INTER} > 0 AND ({shares(16)} OR ({D2} <= 4 * 92 * 92 AND {shares(6)})))
 OR (({_COMMON} * 100 >= least(greatest(800, b.w * 25), greatest(800, a.w * 18)) OR {_GAP} * 100 <= greatest(1200, least(a.w, b.w) * 22) OR abs(2*a.x + a.w - 2*b.x - b.w) * 50 <= greatest(4800, a.w * 55)) AND abs(2*a.y + a.h - 2*b.y - b.h) * 50 <= greatest(3400, (a.h + b.h) * 75)) GROUP BY a.place),
 told AS (SELECT DISTINCT a.place FROM rescued a JOIN colored b ON a.plan_id = b.plan_id WHERE a.hue IS NOT NULL AND b.source = 'pdf_text' AND regexp_full_match(b.name, '[0-9]+_L[0-9]+') AND (b.hue IS NULL OR least(abs(a.hue - b.hue), 180 - abs(a.hue - b.hue)) <= 18)
 AND ((2*b.x + b.w BETWEEN 2 * (a.x - round_even(greatest(72, a.w * 0.45), 0)) AND 2 * (a.x + a.w + round_even(greatest(72, a.w * 0.45), 0)) AND 2*b.y + b.h BETWEEN 2 * (a.y - round_even(greatest(64, a.h * 1.6), 0)) AND 2 * (a.y + a.h + round_even(greatest(64, a.h * 1.6), 0))) OR {shares(4)} OR {D2} * 10000 <= 4 * pow(greatest(9600, a.w * 85), 2))),
 gone AS (SELECT r.place FROM rescued r LEFT JOIN by_waves USING (place) WHERE (content <= 5 AND w * 100 >= h * 245 AND visual_h <= greatest(22, round_even(h * 0.55, 0)) AND r.place NOT IN (SELECT place FROM told)) OR n >= 2 OR (n >= 1 AND (context <= 34 OR verif <= 62)))
 SELECT {_OUT} FROM promoted WHERE place NOT IN (SELECT place FROM gone)"""),
)
def rescued_long_near_waves(spark, d):
    """Final hits after promotion, without rescued long symbols that stand by true waves or are thin strokes without a label."""
    hits = colored(spark, d)
    return shown(C.drop_rescued_long(C.promote_long(finals(hits), hits), hits))


@query(
    "short_symbols",
    with_colored(_LEFT.format(f"SELECT 1 FROM finals b WHERE a.name IN ('08_L8', '09_L9') AND a.source <> 'template_label_disambiguation' AND a.match < 70 AND a.context < 50 AND a.plan_id = b.plan_id AND b.name NOT IN ('08_L8', '09_L9') AND {D2} <= 4 * 85 * 85 AND (b.verif >= a.verif + 8 OR b.context >= 65)")),
)
def short_symbols(spark, d):
    """Final hits without weak short symbols near a fuller one."""
    return shown(staged(C.drop_short, spark, d))


@query("panels_filled", with_colored(f"SELECT {_OUT.replace('place', 'id AS place', 1)} FROM colored WHERE NOT (name LIKE '%TB11%' AND w * h >= 4500 AND greatest(w, h) * 100 <= least(w, h) * 175 AND coverage < 50 AND match < 50 AND verif < 62)"))
def panels_filled(spark, d):
    """Hits without broad panels that have little of their colour."""
    return shown(C.drop_sparse_panels(C.as_finals(colored(spark, d))))


def resolved(spark, d):
    hits = colored(spark, d)
    return C.resolve(finals(hits), hits, words(hits), C.stages(FLOOR_BOX))


@query("color_finals")
def color_finals(spark, d):
    """Final hits after all stages of the chain."""
    return resolved(spark, d)[0].select("plan_id", "place", F.col("id").alias("hit_id"), "template_id", "x", "y", "w", "h", "source", "verif", "context", "stage")


@query("color_stages")
def color_stages(spark, d):
    """How many hits each stage of the chain adds or changes and leaves, by plan."""
    return resolved(spark, d)[1]
