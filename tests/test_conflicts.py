"""The chain of colour stages against a plain sequential model, one hit after the other."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyplan.operators import conflicts as C
from tallyplan.plans import conflicts as P

SCHEMA = "plan_id long, id string, template_id long, name string, hue long, x long, y long, w long, h long, visual_h long, source string, stroke boolean, match long, verif long, coverage long, purity long, context long, content long"
LONG = {"07_L7", "10_L10", "11_L11", "12_L12", "13_L13"}
SHORT = {"08_L8", "09_L9"}


def some_hits(seed, plans=2, n=200, size=900):
    rng = np.random.default_rng(seed)
    ids = [7, 8, 9, 10, 12, 14, 15, 16, 21, 22, 23, 26, 27, 28, 28, 28, 1]
    out = []
    for k in range(plans * n):
        t = int(rng.choice(ids))
        name = P.NAMES[t]
        w, h = (int(v) for v in rng.integers(24, 41, 2))
        if name in LONG:
            w, h = 3 * w + 30, 32 + h % 8
        elif t == 28:
            w *= 2
        elif t == 27:
            w, h = 3 * w, 3 * h
        x, y = (int(v) for v in rng.integers(0, size, 2))
        if out and rng.random() < 0.6:  # near an earlier one of its plan
            x, y = (max(0, out[-int(rng.integers(1, 5)) * plans if len(out) >= 5 * plans else -1][c] + int(rng.integers(-22, 23))) for c in (5, 6))
        match, verif, coverage, purity, context = (int(v) for v in rng.integers((45, 45, 55, 55, 5), (96, 90, 101, 101, 70)))
        source = str(rng.choice(["template", "template_content", "pdf_text"], p=[0.6, 0.25, 0.15]))
        content = int(rng.choice([0, 60]))
        out.append((k % plans, f"h{k:04}", t, name, P.HUES[t], x, y, w, h, h // 2 if rng.random() < 0.5 else h, source, bool(rng.random() < 0.2), match, verif, coverage, purity, context, content))
    out += [(*row[:1], f"{row[1]}b", *row[2:]) for row in out[:9]]  # repeated rows
    return out


class Hit(dict):
    __getattr__ = dict.__getitem__

    def box(self):
        return self.x, self.y, self.w, self.h


def common(a, b):
    return max(0, min(a.x + a.w, b.x + b.w) - max(a.x, b.x)) * max(0, min(a.y + a.h, b.y + b.h) - max(a.y, b.y))


def share(a, b):
    return common(a, b) * 100 / max(1, min(a.w * a.h, b.w * b.h))


def apart(a, b):
    return np.hypot(a.x + a.w / 2 - b.x - b.w / 2, a.y + a.h / 2 - b.y - b.h / 2)


def nested(a, b, px=0, py=0):
    return b.x - px <= a.x + a.w / 2 <= b.x + b.w + px and b.y - py <= a.y + a.h / 2 <= b.y + b.h + py


def wave(h):
    return h.name.startswith("28_TB11")


def rescued(h, source, place=None):
    return Hit(h, source=source, verif=max(h.verif, 58), context=max(h.context, 24), place=place or h["id"])


def best_first(hits, *keys):
    return sorted(hits, key=lambda h: ([-h[k] for k in keys], h["id"]))


def family(h):
    return re.match(r"\d+_sym_\d+", h.name) and h.hue is not None and 135 <= h.hue <= 165


def reclass(out, hits):
    score = lambda h: 30 * h.verif + 14 * h.match + 9 * h.coverage + 5 * h.purity + 5 * h.context
    pool = [h for h in hits if h.source != "pdf_text" and family(h) and h.coverage >= 50 and h.purity >= 55 and h.context >= 20]
    for k, f in enumerate(out):
        same = [h for h in pool if share(h, f) >= 55 or (apart(h, f) <= max(24, 0.48 * min(h.w, h.h, f.w, f.h)) and share(h, f) >= 22) or ((nested(h, f) or nested(f, h)) and share(h, f) >= 35)]
        if family(f) and same:
            best = min(same, key=lambda h: (-score(h), h["id"]))
            if score(best) > score(f) + 120 and (best.template_id, best.box()) != (f.template_id, f.box()):
                out[k] = rescued(best, "template_family_reclass", f.place)
    return out


def rescue(out, hits):
    visual = [h for h in hits if h.source != "pdf_text"]

    def fits(h):
        strong = h.verif >= 55 or (h.match >= 56 and h.stroke)
        rival = any(o.name in LONG and (share(h, o) >= 8 or apart(h, o) <= 86) and o.match >= max(56, h.match + 4) and o.coverage >= 55 and o.purity >= 62 for o in visual)
        return wave(h) and h.hue is not None and strong and h.coverage >= 80 and h.purity >= 55 and h.context >= 14 and not rival

    for h in best_first(filter(fits, visual), "verif", "match", "coverage", "purity"):
        if not any(o.template_id == h.template_id and (share(o, h) >= 42 or apart(o, h) <= 18) for o in out):
            out.append(rescued(h, "template_wave_rescue"))
    return out


def local_long(h, hits):
    pool = [o for o in hits if o.name in LONG and o.source != "pdf_text" and o.match >= 60 and o.coverage >= 68 and o.purity >= 70 and o.context >= 35 and max(o.w, o.h) * 100 >= 245 * min(o.w, o.h) and min(o.w, o.h) >= 32]
    near = [o for o in pool if (share(h, o) >= 40 or (apart(h, o) <= 42 and share(h, o) >= 20)) and (o.match >= h.match + 6 or (o.match >= 62 and o.coverage >= 73 and o.purity >= 72 and h.context <= 32))]
    return best_first(near, "match", "coverage", "purity", "context", "verif")[:1]


def promote(out, hits):
    for k, f in enumerate(out):
        for best in local_long(f, hits) if wave(f) else ():
            out[k] = rescued(best, "template_long_l_rescue", f.place)
    return out


def add_long(out, hits):
    seen, added = {(o.template_id, o.box()) for o in out}, 0
    fits = [h for h in hits if wave(h) and h.source != "pdf_text" and h.match >= 50 and h.coverage >= 70 and h.purity >= 50 and h.context <= 35]
    for h in best_first(fits, "match", "coverage", "purity"):
        if added >= 4:
            break
        if any(o.name in LONG and (share(o, h) >= 25 or apart(o, h) <= 46) for o in out):
            continue
        for best in local_long(h, hits):
            if best.match >= 62 and best.coverage >= 68 and best.purity >= 72 and (best.template_id, best.box()) not in seen:
                out.append(rescued(best, "template_long_l_rescue"))
                seen.add((best.template_id, best.box()))
                added += 1
    return out


def drop_waves(out, hits):
    pool = [o for o in out + hits if o.name in LONG and o.source != "pdf_text" and o.match >= 56 and o.coverage >= 55 and o.purity >= 62]
    return [f for f in out if not (wave(f) and any((share(f, o) >= 8 or apart(f, o) <= 86) and o.match >= max(56, f.match + 4) for o in pool))]


def pel(h):
    return re.fullmatch(r"\d+_PEL\d+[A-Z]?", h.name)


def floor_boxes(out, words):
    for k, f in enumerate(out):
        pads = round(max(70.0, f.w * 0.75)), round(max(34.0, f.h * 0.55))
        if pel(f) and any(w.token.startswith("PEL") and w.token.endswith("PP") and nested(w, f, *pads) for w in words):
            out[k] = Hit(f, template_id=23, name=P.NAMES[23], hue=P.HUES[23], source="template_label_disambiguation")
    return out


def labelled(out, hits, words):
    for h in best_first(hits, "verif", "match", "coverage", "purity"):
        fits = pel(h) and h.source != "pdf_text" and h.match >= 56 and h.verif >= 70 and h.coverage >= 55 and h.purity >= 88
        pads = round(max(48.0, h.w * 0.70)), round(max(42.0, h.h * 0.72))
        if fits and any(w.token == h.name.split("_", 1)[1] and nested(w, h, *pads) for w in words):
            if not any(o.template_id == h.template_id and o.source != "pdf_text" and apart(o, h) <= max(20, 0.55 * min(o.w, o.h, h.w, h.h)) for o in out):
                out.append(Hit(h, place=h["id"]))
    return out


def drop_rescued(out, hits):
    waves = [o for o in out if wave(o) and o.source != "pdf_text" and o.match >= 50 and o.verif >= 50 and o.coverage >= 75 and o.purity >= 52]
    labels = [h for h in hits if h.source == "pdf_text" and re.fullmatch(r"\d+_L\d+", h.name)]

    def related(f, o):
        over = max(0, min(f.x + f.w, o.x + o.w) - max(f.x, o.x))
        gap = max(0, max(f.x, o.x) - min(f.x + f.w, o.x + o.w))
        beside = over >= min(max(8, o.w / 4), max(8, f.w * 0.18)) or gap <= max(12, min(f.w, o.w) * 0.22) or abs(f.x + f.w / 2 - o.x - o.w / 2) <= max(48, f.w * 0.55)
        return share(f, o) >= 16 or (apart(f, o) <= 92 and share(f, o) >= 6) or (beside and abs(f.y + f.h / 2 - o.y - o.h / 2) <= max(34, (f.h + o.h) * 0.75))

    def told(f):
        pads = round(max(72.0, f.w * 0.45)), round(max(64.0, f.h * 1.60))
        hued = [o for o in labels if o.hue is None or min(abs(o.hue - f.hue), 180 - abs(o.hue - f.hue)) <= 18]
        return any(nested(o, f, *pads) or share(o, f) >= 4 or apart(o, f) <= max(96, f.w * 0.85) for o in hued)

    def goes(f):
        if not waves or f.source != "template_long_l_rescue" or f.name not in LONG:
            return False
        if f.content <= 5 and f.w >= f.h * 2.45 and f.visual_h <= max(22, round(f.h * 0.55)) and not told(f):
            return True
        n = sum(related(f, o) for o in waves)
        return n >= 2 or (n >= 1 and (f.context <= 34 or f.verif <= 62))

    return [f for f in out if not goes(f)]


def drop_short(out):
    def goes(f):
        weak = f.name in SHORT and f.source != "template_label_disambiguation" and f.match < 70 and f.context < 50
        return weak and any(o.name not in SHORT and o.source != "pdf_text" and apart(f, o) <= 85 and (o.verif >= f.verif + 8 or o.context >= 65) for o in out)

    return [f for f in out if not goes(f)]


def sequential(finals, hits, words):
    """The final hits, and after each stage their number and how many differ."""
    out, sizes = [Hit(f, place=f["id"]) for f in finals], []
    steps = [
        lambda o: reclass(o, hits), lambda o: rescue(o, hits), lambda o: promote(o, hits), lambda o: add_long(o, hits), lambda o: drop_waves(o, hits), lambda o: floor_boxes(o, words),
        lambda o: labelled(o, hits, words), lambda o: drop_rescued(o, hits), drop_short,
        lambda o: [f for f in o if not ("TB11" in f.name and f.w * f.h >= 4500 and max(f.w / f.h, f.h / f.w) <= 1.75 and f.coverage < 50 and f.match < 50 and f.verif < 62)],
    ]
    for step in steps:
        before = {(f.place, *key(f)) for f in out}
        out = step(out)
        sizes.append((len(out), len(before ^ {(f.place, *key(f)) for f in out})))
    best = {}
    for f in sorted(out, key=lambda f: [-f[k] for k in ("verif", "match", "coverage", "purity", "context")]):
        best.setdefault((f.template_id, f.box()), f)
    return list(best.values()), [*sizes, (len(best), len(out) - len(best))]


def key(h):
    return (h["plan_id"], h["template_id"], h["x"], h["y"], h["w"], h["h"], h["source"], *(h[m] for m in C.MEASURES))


@pytest.mark.parametrize("seed", [4, 8])
def test_chain_equals_the_sequential_one(spark, seed):
    rows = some_hits(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    finals = df.where("verif >= 58 and source <> 'pdf_text' and substring(id, 5, 1) <> '3'")
    state, counts = C.resolve(C.as_finals(finals), df, P.words(df), C.stages(P.FLOOR_BOX))
    got, left = sorted(key(r.asDict()) for r in state.collect()), {(r.plan_id, r.turn): (r.changed, r.left) for r in counts.collect()}
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    hits = [Hit(zip(columns, r)) for r in rows]
    expected, moves = [], np.zeros(11, int)
    for plan in (0, 1):
        own = [h for h in hits if h.plan_id == plan]
        words = [Hit(h, token=re.sub("[^A-Z0-9]", "", h.name.split("_", 1)[1])) for h in own if h.source == "pdf_text"]
        first = [h for h in own if h.verif >= 58 and h.source != "pdf_text" and h["id"][4] != "3"]
        out, sizes = sequential(first, own, words)
        expected += out
        assert [left[plan, k][1] for k in range(11)] == [n for n, _ in sizes]
        moves += [m for _, m in sizes]
    assert got == sorted(map(key, expected))
    assert (moves[[0, 1, 2, 4, 5, 8, 10]] > 0).all(), moves


def test_every_stage_acts(spark):
    """One plan a case; the hits that a case leaves, by their ids."""
    base = dict(zip((c.split()[0] for c in SCHEMA.split(", ")), (0, "", 0, "", 5, 0, 0, 30, 30, 30, "template", False, 70, 70, 70, 80, 40, 60)))
    cases, made = {}, []

    def case(stage, left, *hits):
        cases[len(cases)] = stage, left
        for k, (t, changes) in enumerate(hits):
            made.append({**base, "plan_id": len(cases) - 1, "id": f"{len(cases) - 1}-{k}", "template_id": t, "name": P.NAMES[t], "hue": P.HUES[t], **changes})

    long = dict(w=100, h=34, match=80, context=50)
    case("long_gained", ["0", "long"], (1, dict(x=500)), (28, dict(w=60, context=20, verif=10)), (10, {**long, "verif": 10}))
    case("labelled_rescued", ["0", "0"], (21, dict(verif=75, purity=90)), (21, dict(x=60, verif=75, purity=90, context=1)), (21, dict(x=30, source="pdf_text", verif=10)))
    case("rescued_long_dropped", ["0"], (28, dict(x=40, y=30, w=60, match=90, coverage=90)), (10, {**long, "source": "template_long_l_rescue", "context": 30}))
    case("sparse_panels_dropped", [], (27, dict(w=90, h=90, verif=58, coverage=40, match=45)))
    case("repeats_dropped", ["0"], (1, {}), (1, dict(verif=60)))
    df = spark.createDataFrame([tuple(m.values()) for m in made], SCHEMA)
    first = df.where("verif >= 58 and source <> 'pdf_text' and context > 1")
    stages = dict(C.stages(P.FLOOR_BOX))
    for plan, (stage, left) in cases.items():
        out = stages[stage](C.as_finals(first.where(f"plan_id = {plan}")), df, P.words(df)).collect()
        assert len(out) == len(left), (stage, out)
        if stage == "long_gained":
            assert {r.source for r in out} == {"template", "template_long_l_rescue"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    state, counts = C.resolve(C.as_finals(none), none, P.words(none), C.stages(P.FLOOR_BOX))
    assert state.count() == 0 and counts.count() == 0


def test_stages_write_what_they_may_change(spark, monkeypatch):
    """Final hits are written once, hits that no stage reads never, and what stages write is less than the final hits."""
    tables, real = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: (lambda out: tables.append(out) or out)(real(df)))
    hits, chain = P.colored(spark, "/root/testdata/sf0.001"), C.stages(P.FLOOR_BOX)
    first = P.finals(hits)
    _, counts = C.resolve(first, hits, P.words(hits), chain)
    n, finals = hits.count(), first.count()
    read, words, kept, *new = (t.count() for t in tables)
    assert (kept, len(new)) == (finals, len(chain) - 1)
    assert read < n / 3 and words < n / 3 and 0 < sum(new) < finals / 2
    changed = {r.turn: r.n for r in counts.groupBy("turn").agg(F.sum("changed").alias("n")).collect()}
    assert changed == {k: table.where(F.col("stage") == name).count() for k, (table, (name, _)) in enumerate(zip(tables[3:], chain))} | {len(chain) - 1: 0}
