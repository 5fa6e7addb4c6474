"""Label and token queries."""

from pyspark.sql import functions as F

from tallyplan.functions import text as X
from tallyplan.plans.base import query, table

_RAW = "SELECT p_partkey, concat(' ', p_name, ' ', p_type, CASE p_partkey % 5 WHEN 0 THEN ' (230V) żółty' WHEN 1 THEN ' 3-F z bolcem ochronnym, 16A IP44' WHEN 2 THEN ' zestaw 2x16A' WHEN 3 THEN ' rozdz. główna' ELSE '_a/b' END) AS raw FROM part"


def raw_labels(spark, d):
    tail = F.when(F.col("p_partkey") % 5 == 0, " (230V) żółty").when(F.col("p_partkey") % 5 == 1, " 3-F z bolcem ochronnym, 16A IP44").when(F.col("p_partkey") % 5 == 2, " zestaw 2x16A").when(F.col("p_partkey") % 5 == 3, " rozdz. główna").otherwise("_a/b")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit(" "), "p_type", tail).alias("raw"))


_FRAGMENT = r"regexp_replace(substr(translate(regexp_replace(regexp_replace(trim({0}), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '_', 'g'), 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ'), 1, 80), '^_+|_+$', '', 'g')"


@query("sanitize_filename", f"SELECT p_partkey, {_FRAGMENT.format('raw')} AS name FROM ({_RAW})")
def sanitize_filename(spark, d):
    return raw_labels(spark, d).select("p_partkey", X.file_fragment(F.col("raw")).alias("name"))


@query(
    "label_clean",
    f"""WITH r AS (SELECT p_partkey, trim(regexp_replace(translate(raw, '_', ' '), '\\s+', ' ', 'g')) AS raw FROM ({_RAW})),
 c AS (SELECT *, regexp_replace(translate(upper(raw), 'ĄĆĘŁŃÓŚŹŻ', 'ACELNOSZZ'), '[^A-Z0-9]+', ' ', 'g') AS k, trim(regexp_replace(regexp_replace(raw, '[^0-9A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż+\\-/ ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS words FROM r)
 SELECT p_partkey, CASE WHEN k LIKE '%ROZDZ%' THEN CASE WHEN k LIKE '%GLOWNA%' THEN words ELSE 'ROZDZIELNICA' END
 WHEN k LIKE '%ZESTAW%' AND k LIKE '%2X16%' THEN 'ZESTAW GNIAZD 2x16A 3f 2x16A 1f'
 WHEN k LIKE '%BOLCEM%' OR k LIKE '%OCHRONNY%' THEN 'GNIAZDO 3-F Z BOLCEM OCHRONNYM 16A IP44'
 ELSE array_to_string(list_slice(string_split(words, ' '), 1, 12), ' ') END AS label FROM c""",
)
def label_clean(spark, d):
    return raw_labels(spark, d).select("p_partkey", X.clean_label(F.col("raw")).alias("label"))


_CODE = "concat(substr(p_brand, length(p_brand) - 1, 2), CASE WHEN p_partkey % 3 = 0 THEN 'X2' WHEN p_partkey % 3 = 1 THEN '-tb' ELSE ' 16A long text' END)"


def codes(spark, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, "X2").when(F.col("p_partkey") % 3 == 1, "-tb").otherwise(" 16A long text")
    return table(spark, d, "part").select("p_partkey", F.concat(F.expr("substr(p_brand, length(p_brand) - 1, 2)"), tail).alias("code"))


@query(
    "symbol_token",
    f"""WITH t AS (SELECT p_partkey, upper({_FRAGMENT.format(_CODE)}) AS token FROM part), b AS (SELECT *, replace(token, '_', '') AS bare FROM t)
 SELECT p_partkey, CASE WHEN regexp_full_match(token, '[A-Z0-9_]{{2,12}}') AND length(bare) BETWEEN 2 AND 10 AND regexp_matches(bare, '[A-Z]') AND (regexp_matches(bare, '[0-9]') OR length(bare) <= 4) AND NOT regexp_full_match(bare, '[0-9]+(X[0-9]+)+') THEN bare END AS token FROM b""",
)
def symbol_token(spark, d):
    return codes(spark, d).select("p_partkey", X.symbol_token(F.col("code")).alias("token"))


@query("row_label_prefix", f"SELECT p_partkey, regexp_full_match(b, '[0-9]*') OR regexp_full_match(b, '[A-Za-z]{{0,4}}[0-9]{{1,4}}[A-Za-z]?') OR lower(b) IN ('lp', 'l.p', 'nr', 'no', 'poz', 'pos') AS is_prefix FROM (SELECT p_partkey, regexp_replace({_CODE}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS b FROM part)")
def row_label_prefix(spark, d):
    return codes(spark, d).select("p_partkey", X.row_prefix(F.col("code")).alias("is_prefix"))


@query(
    "generic_tokens",
    f"""SELECT p_partkey, b = '' OR regexp_full_match(b, '[0-9]+X') OR regexp_full_match(b, '[0-9]+(V|A|M|MM|CM|MB|GB)') OR regexp_full_match(b, 'IP[0-9]{{0,2}}') AS generic FROM (SELECT p_partkey, regexp_replace(upper(CASE WHEN p_partkey % 2 = 0 THEN concat(p_size, 'A') ELSE {_CODE} END), '[^A-Z0-9]+', '', 'g') AS b FROM part)""",
)
def generic_tokens(spark, d):
    size = table(spark, d, "part").select("p_partkey", "p_size")
    token = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("A"))).otherwise(F.col("code"))
    return codes(spark, d).join(size, "p_partkey").select("p_partkey", X.generic_token(token).alias("generic"))


@query(
    "token_equi_match",
    """WITH t AS (SELECT DISTINCT upper(string_split(p_name, ' ')[1]) AS token FROM part), w AS (SELECT doc_id, regexp_replace(upper(unnest(string_split_regex(text, '[ \\n\\t\\r\\f\\x0B]+'))), '[^A-Z0-9]', '', 'g') AS token FROM documents)
 SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w JOIN (SELECT token FROM t UNION SELECT 'THE' UNION SELECT 'DER' UNION SELECT 'QUE') USING (token) GROUP BY token""",
)
def token_equi_match(spark, d):
    """Whole normalised tokens of texts that equal a template's token."""
    part = table(spark, d, "part").select(F.upper(F.split("p_name", " ")[0]).alias("token"))
    wanted = part.unionByName(spark.createDataFrame([("THE",), ("DER",), ("QUE",)], "token string")).distinct()
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \n\t\r\f\x0B]+")).alias("w")).select("doc_id", X.full_token(F.col("w")).alias("token"))
    per_document = words.join(wanted, "token").groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_document.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("token_families", "SELECT regexp_extract(upper(p_brand), '^([A-Z]+)[0-9]*', 1) AS family, count(*) AS n FROM part GROUP BY 1")
def token_families(spark, d):
    return table(spark, d, "part").groupBy(X.token_family(F.col("p_brand")).alias("family")).agg(F.count("*").alias("n"))


@query(
    "column_names",
    """WITH p AS (SELECT CAST(p_partkey % 18278 + 1 AS BIGINT) AS k FROM part), q AS (SELECT k, (k - 1) // 26 - 1 AS two FROM p), r AS (SELECT k, two, two // 26 - 1 AS three FROM q)
 SELECT k, concat(CASE WHEN two >= 26 THEN chr(CAST(65 + three % 26 AS INTEGER)) ELSE '' END, CASE WHEN k > 26 THEN chr(CAST(65 + two % 26 AS INTEGER)) ELSE '' END, chr(CAST(65 + (k - 1) % 26 AS INTEGER))) AS name FROM r""",
)
def column_names(spark, d):
    """Spreadsheet letters of the columns from 1 on."""
    rows = table(spark, d, "part").select((F.col("p_partkey") % 18278 + 1).cast("long").alias("k"))
    return rows.select("k", X.column_name(F.col("k")).alias("name"))


@query("json_fallback_paths", "SELECT event_id, coalesce(json_extract_string(props, '$.symbol'), json_extract_string(props, '$.k')) AS v FROM events")
def json_fallback_paths(spark, d):
    """The first of two paths that a record has."""
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.symbol"), F.get_json_object("props", "$.k")).alias("v"))


@query(
    "label_map_merge",
    "SELECT p_brand AS symbol, CASE WHEN max(p_size) > 45 THEN 'requested' ELSE min(p_type) END AS label FROM part GROUP BY p_brand",
)
def label_map_merge(spark, d):
    """Stored labels, overridden by a request's."""
    part = table(spark, d, "part")
    stored = part.groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_type").alias("label"), F.max("p_size").alias("size"))
    return stored.select("symbol", F.coalesce(F.when(F.col("size") > 45, "requested"), "label").alias("label"))


@query("hue_distance", "SELECT CAST(p_partkey AS BIGINT) AS k, least(abs(p_partkey * 7 % 180 - p_size * 11 % 180), 180 - abs(p_partkey * 7 % 180 - p_size * 11 % 180)) AS hue FROM part")
def hue_distance(spark, d):
    from tallyplan.functions.geometry import hue_distance as hue

    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), hue(F.col("p_partkey") * 7 % 180, F.col("p_size") * 11 % 180).alias("hue"))
