"""Personal data: base patterns, and bootstrapped contextual extraction, all in DataFrame expressions.

Seeds (tokens that a base pattern covers) induce lexical patterns (the two words before them; marks stand for tokens
among those and for the start of the text). A token after one word only may go by that word alone. Pattern-instance graphs
are scored in rounds: a pattern by the share of known instances among all it has, an instance by its best pattern.
Patterns of high confidence then mark tokens that no base pattern knows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Starts are held to the start of a run of their first class, or to the end of the last
# match, where a match could begin just as well; this and possessive repeats keep them linear on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token that may be an identifier: it holds a digit or an at sign. Marks around it aren't part of it.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

ROUNDS = 3
MIN_INSTANCES, MIN_CONFIDENCE = 5, 0.8
MIN_LENGTH = 6
#: Words of a context that aren't in the text: its start, any word at all, and an earlier token.
START, ANY, EARLIER = "\x02", "\x03", "\x04"


#: Matches that are laid out one by one; blocks of them are then moved to their place, so that long texts stay cheap.
BLOCK = 512
SPAN = "struct<start:int,end:int,match:string,gap:string>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, match, gap), in code points; gap is the text before it."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(acc: Column, pair: Column) -> Column:
        gap, match = F.coalesce(pair["g"], F.lit("")), pair["m"]
        first = acc["at"] + F.length(gap)
        last = first + F.length(match)
        one = F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"), match.alias("match"), gap.alias("gap"))
        return F.when(match.isNull(), acc).otherwise(F.struct(last.cast("int").alias("at"), F.array_append(acc["out"], one).alias("out")))

    def laid_out(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), _none(SPAN).alias("out")), step)

    def moved(acc: Column, block: Column) -> Column:
        there = F.transform(block["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["match"].alias("match"), s["gap"].alias("gap")))
        return F.struct((acc["at"] + block["at"]).cast("int").alias("at"), F.array_append(acc["out"], there).alias("out"))

    def whole(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK)), lambda i: laid_out(F.slice(all_, i, BLOCK)))
        many = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), _none(f"array<{SPAN}>").alias("out")), moved, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(all_) <= BLOCK, laid_out(all_)["out"]).otherwise(many)

    return _bound(pairs, whole)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits pass the Luhn sum."""

    def weigh(k: Column) -> Column:
        d = F.substr(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _part_fits(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.lpad(F.substring(bare, 1, 3), 3, "0") <= "255")


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _part_fits),
    "card": lambda m: _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one base kind as structs (kind number, start, end)."""
    may = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    hits = F.filter(found(text, PATTERNS[kind]), lambda s: VALID[kind](s["match"]))
    spans = F.transform(hits, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(may, spans).otherwise(none)


def candidates(text: Column) -> Column:
    """Tokens that may be identifiers, with their span and the two words before them."""
    kind = "array<struct<start:int,end:int,token:string,context:string>>"
    none = F.expr(f"cast(array() as {kind})")

    def shape(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["match"], r"^[^A-Za-z0-9+@]*", 0))
        token = F.regexp_replace(s["match"], r"^[^A-Za-z0-9+@]+|[^A-Za-z0-9@]+$", "")
        back = F.reverse(s["gap"])  # words are taken from its start, so that no gap is read twice
        last, other = (F.lower(F.reverse(F.regexp_extract(back, pattern, 1))) for pattern in (r"^\s*+(\S++)", r"^\s*+\S++\s++(\S++)"))
        first = s["start"] + lead
        return F.struct(first.cast("int").alias("start"), (first + F.length(token)).cast("int").alias("end"), token.alias("token"), last.alias("last"), other.alias("other"))

    def before(k: Column) -> Column:
        return F.when(k > 0, F.lit(EARLIER)).otherwise(F.lit(START))

    def last_word(s: Column, k: Column) -> Column:
        return F.when(s["last"] != "", s["last"]).otherwise(before(k))

    def placed(tokens: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            earlier = F.when(k > 0, last_word(F.get(tokens, k - 1), k - 1)).otherwise(F.lit(START))
            other = F.when(s["other"] != "", s["other"]).when(s["last"] != "", before(k)).otherwise(earlier)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), F.concat(other, F.lit(" "), last_word(s, k)).alias("context"))

        return F.transform(tokens, one)

    got = _bound(F.transform(found(text, TOKEN), shape), placed)
    return F.when(text.rlike("[0-9@]"), F.filter(got, lambda c: F.length(c["token"]) >= 2)).otherwise(none)


def _contexts() -> Column:
    """A token's contexts and whether it may be taken for one: its two words, and the last alone if no more are before it."""
    alone = F.col("context").startswith(f"{START} ") & (F.col("context") != f"{START} {START}")
    short = F.concat(F.lit(f"{ANY} "), F.substring_index("context", " ", -1))
    return F.explode(F.array(F.struct(F.col("context"), F.lit(True).alias("taken")), F.struct(short.alias("context"), alone.alias("taken"))))


def annotate(docs: DataFrame, *carry: str) -> DataFrame:
    """docs with text_key, spans by kind, and candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(*carry, text.alias("_text"))
    return out.select(*carry, "_text", F.xxhash64("_text").alias("text_key"), *(base_spans(F.col("_text"), k).alias(k) for k in KINDS), candidates(F.col("_text")).alias("candidates"))


def discover(notes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """New spans (doc_id, text_key, kind, start, end) from ``notes(doc_id, text_key, spans, candidates)``."""
    one = notes.where("size(candidates) > 0").select("doc_id", "text_key", "spans", F.explode("candidates").alias("c")).select("doc_id", "text_key", "spans", "c.*")
    covering = F.filter("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    one = C.materialize(one.select("doc_id", "text_key", "start", "end", "token", "context", F.get(F.transform(covering, lambda s: s["kind"]), F.lit(0)).alias("seed")), "pii-tokens")
    # the graph: patterns and instances, counted once each however often a pair repeats
    by_context = one.select("token", "seed", _contexts().alias("x")).groupBy("x.context", "token")
    edges = C.materialize(by_context.agg(F.max("seed").alias("seed"), F.max("x.taken").alias("taken")), "pii-edges")
    known = edges.groupBy("token").agg(F.max("seed").alias("seed")).select("token", "seed", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    for _ in range(rounds):
        scored = edges.select("context", "token").join(known, "token")
        patterns = scored.groupBy("context", "seed").agg(F.sum("score").alias("mass"), F.count("*").alias("n")).groupBy("context").agg(
            F.sum("n").alias("n"), F.max(F.struct("mass", "seed")).alias("best")
        )
        patterns = C.materialize(patterns.where("best.seed is not null").select("context", "n", F.col("best.seed").alias("kind"), (F.col("best.mass") / F.col("n")).alias("confidence")), "pii-patterns")
        strong = patterns.where((F.col("n") >= MIN_INSTANCES) & (F.col("confidence") >= MIN_CONFIDENCE))
        gained = edges.where("taken").select("context", "token").join(strong, "context").groupBy("token").agg(F.max(F.struct("confidence", "kind")).alias("g"))
        known = C.materialize(
            edges.groupBy("token").agg(F.max("seed").alias("own")).join(gained, "token", "left").select(
                "token", F.coalesce("own", F.when(F.col("g.confidence") >= MIN_CONFIDENCE, F.col("g.kind"))).alias("seed"), F.when(F.col("own").isNotNull(), 1.0).otherwise(F.coalesce(F.col("g.confidence"), F.lit(0.0))).alias("score")
            ),
            "pii-known",
        )
    fresh = one.where(f"seed is null and length(token) >= {MIN_LENGTH}").select("doc_id", "text_key", "start", "end", _contexts().alias("x")).where("x.taken")
    fresh = fresh.select("doc_id", "text_key", "start", "end", "x.context").join(strong.select("context", "confidence", "kind"), "context")
    best = fresh.groupBy("doc_id", "text_key", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    return best.select("doc_id", "text_key", F.col("best.kind").alias("kind"), "start", "end")


def _text_of(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])))


def _gathered(new: DataFrame) -> DataFrame:
    return new.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))  # of one text


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans, for every row of ``docs(doc_id, text, ...)``.

    A null text is empty and has no span; a null doc_id stays null; rows that repeat get the same spans each; very long texts
    are read whole; of patterns with equal confidence the first kind in reverse order of KINDS decides; an empty table gives no
    rows; further columns are not used.
    """
    notes = annotate(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id").select("doc_id", "text_key", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.concat(*KINDS).alias("spans"), "candidates")
    notes = C.materialize(notes, "pii")
    some = notes.where("size(candidates) > 0").drop("candidates")
    new = _gathered(discover(notes)).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    joined = some.join(new, some["doc_id"].eqNullSafe(F.col("_id")) & (some["text_key"] == F.col("_key")), "left")
    kind = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    whole = joined.drop("_id", "_key").unionByName(notes.where("size(candidates) = 0").drop("candidates").withColumn("new", F.lit(None).cast("array<struct<kind:int,start:int,end:int>>")))
    return whole.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_text_of(F.col("spans")), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("spans", F.coalesce("new", kind)))).alias("spans"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(C.documents(spark, sf_dir, "doc_id", "text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span becomes its kind in angle brackets; n_chars follows the text, a null text stays null.

    Of spans that overlap the first stays, of those that start together the shortest. Rows with a null doc_id, repeated rows
    and very long texts are redacted like any other; an empty table gives no rows; further columns pass, whatever their names.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    own_, id_, key_, spans_ = C.fresh_names(docs, "own", "id", "key", "spans")
    notes = annotate(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id").select("doc_id", "text_key", F.concat(*KINDS).alias("spans"), "candidates").where("size(candidates) > 0 or size(spans) > 0")
    notes = C.materialize(notes, "pii-stage")
    found_ = notes.where("size(spans) > 0").select("doc_id", "text_key", F.explode("spans").alias("s")).select("doc_id", "text_key", "s.kind", "s.start", "s.end")
    spans = C.materialize(_gathered(found_.unionByName(discover(notes)).distinct()), "pii-spans").withColumnRenamed("doc_id", id_).withColumnRenamed("text_key", key_).withColumnRenamed("new", spans_)
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))  # a span always holds one of these
    hit = docs.where(may).withColumn(own_, key)
    joined = hit.join(spans, hit["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.col(own_) == F.col(key_)), "left")
    name = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        text = F.when(apart, F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.get(name, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("out"))

    by_start = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cut = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    done = joined.withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return done.select(*docs.columns).unionByName(docs.where(~may))
