"""Winners of places by a chain of preferences."""

from pyspark.sql import functions as F

from tallyplan.operators import preferences as P
from tallyplan.plans.base import query
from tallyplan.plans.rules import measured, with_measured


def full_label(h):
    """A complete gray label of its own."""
    own = ((h("source") == 0) & (h("match") >= 62)) | ((h("source") == 1) & (h("match") >= 70) & (h("content") >= 82))
    return (h("gray") == 1) & (h("text") == 1) & (h("scale") >= 85) & (h("area") >= 1000) & (h("aspect") >= 135) & (h("coverage") >= 88) & (h("purity") >= 34) & (h("content") >= 70) & (h("verif") >= 66) & own


def tiny(w):
    """A small gray symbol that validates by its own geometry."""
    return (w("gray") == 1) & (w("text") == 0) & (w("pixels") <= 360) & (w("verif") >= 58) & (w("coverage") >= 98) & (w("purity") >= 50) & (w("context") >= 23)


# The bounds of the preferences, in percent.
STEPS = [
    P.Step(
        "full_label", lambda h, w: full_label(h) & ~full_label(w), lambda h: [h(c) for c in ("content", "verif", "match", "coverage", "purity", "area")],
        lambda b, w: (w("source") == 1) & (w("purity") <= 35) & (w("context") <= 18) & (b("area") * 100 >= w("area") * 145) & (b("purity") >= w("purity") + 30),
    ),
    P.Step("fuller_label", lambda h, w: (w("text") == 1) & (h("text") == 1) & (h("area") * 100 >= w("area") * 112) & (h("content") + 8 >= w("content")) & (h("verif") + 8 >= w("verif")), lambda h: [h(c) for c in ("area", "content", "verif", "match")]),
    P.Step(
        "fuller_gray",
        lambda h, w: (w("gray") == 1) & (w("text") == 0) & (h("gray") == 1) & (h("text") == 0) & ~(tiny(w) & (h("template_id") != w("template_id")) & (h("verif") <= w("verif") + 2)) & (h("area") * 100 >= w("area") * 155) & (h("coverage") >= 94) & (h("purity") >= 40) & (h("verif") + 8 >= w("verif")),
        lambda h: [h(c) for c in ("area", "verif", "match")],
    ),
]

_FULL = "({0}.gray = 1 AND {0}.text = 1 AND {0}.scale >= 85 AND {0}.area >= 1000 AND {0}.aspect >= 135 AND {0}.coverage >= 88 AND {0}.purity >= 34 AND {0}.content >= 70 AND {0}.verif >= 66 AND (({0}.source = 0 AND {0}.match >= 62) OR ({0}.source = 1 AND {0}.match >= 70 AND {0}.content >= 82)))"
_PICK = "SELECT h.*, row_number() OVER (PARTITION BY h.plan_id, h.cx, h.cy ORDER BY {order}, h.hit_id) AS k FROM m h JOIN {won} w USING (plan_id, cx, cy) WHERE h.hit_id <> w.hit_id AND {pool}"
_NEXT = "SELECT b.* EXCLUDE (k), w.why || CASE WHEN w.why = '' THEN '' ELSE ',' END || '{name}' AS why FROM {name}_pool b JOIN {won} w USING (plan_id, cx, cy) WHERE k = 1 AND {accept} UNION ALL SELECT w.* FROM {won} w WHERE NOT EXISTS (SELECT 1 FROM {name}_pool b WHERE k = 1 AND b.plan_id = w.plan_id AND b.cx = w.cx AND b.cy = w.cy AND {accept})"


def _chain_sql() -> str:
    steps = [
        ("full_label", f"{_FULL.format('h')} AND NOT {_FULL.format('w')}", "h.content DESC, h.verif DESC, h.match DESC, h.coverage DESC, h.purity DESC, h.area DESC", "w.source = 1 AND w.purity <= 35 AND w.context <= 18 AND b.area >= w.area * 1.45 AND b.purity >= w.purity + 30"),
        ("fuller_label", "w.text = 1 AND h.text = 1 AND h.area >= w.area * 1.12 AND h.content >= w.content - 8 AND h.verif >= w.verif - 8", "h.area DESC, h.content DESC, h.verif DESC, h.match DESC", "true"),
        ("fuller_gray", "w.gray = 1 AND w.text = 0 AND h.gray = 1 AND h.text = 0 AND NOT (w.pixels <= 360 AND w.verif >= 58 AND w.coverage >= 98 AND w.purity >= 50 AND w.context >= 23 AND h.template_id <> w.template_id AND h.verif <= w.verif + 2) AND h.area >= w.area * 1.55 AND h.coverage >= 94 AND h.purity >= 40 AND h.verif >= w.verif - 8", "h.area DESC, h.verif DESC, h.match DESC", "true"),
    ]
    parts, won = ["m AS (SELECT *, x // 160 AS cx, y // 160 AS cy FROM measured)", "base AS (SELECT *, '' AS why FROM m QUALIFY row_number() OVER (PARTITION BY plan_id, cx, cy ORDER BY verif DESC, match DESC, area DESC, hit_id) = 1)"], "base"
    for name, pool, order, accept in steps:
        parts += [f"{name}_pool AS ({_PICK.format(order=order, won=won, pool=pool)})", f"{name} AS ({_NEXT.format(name=name, won=won, accept=accept)})"]
        won = name
    return f"{', '.join(parts)} SELECT plan_id, cx, cy, hit_id, why FROM {won}"


@query("winner_chain", with_measured(_chain_sql()))
def winner_chain(spark, d):
    """The winner of each place of 160 pixels: its best hit, then a full label, a fuller label and a fuller gray symbol in turn."""
    columns = ["hit_id", "template_id", "match", "verif", "coverage", "purity", "context", "content", "scale", "gray", "text", "source", "pixels", "area", "aspect"]
    m = measured(spark, d).select("plan_id", F.floor(F.col("x") / 160).alias("cx"), F.floor(F.col("y") / 160).alias("cy"), *columns)
    return P.winners(m, ["plan_id", "cx", "cy"], "hit_id", [-F.col("verif"), -F.col("match"), -F.col("area")], STEPS)
