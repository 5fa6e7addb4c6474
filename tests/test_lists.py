"""Lists and values against plain models, on tables of their own."""

import base64
import hashlib
import random

import duckdb

from tallyplan.plans import lists
from tallyplan.plans.catalogue import ORACLE_SQL, QUERIES


def test_digests_have_no_line_breaks(spark, tmp_path):
    rows = [(1, "http://example.org/" + "a" * 60, "x"), (2, "http://ex/" + "é" * 70, "é"), (3, None, None), (4, "", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.digest, r.url64) for r in QUERIES["file_digests"](spark, str(tmp_path)).collect()}
    assert got == {k: (h if h is None else hashlib.sha256(h.encode()).hexdigest(), u if u is None else base64.b64encode(u[:60].encode()).decode()) for k, u, h in rows}


def _parts(spark, folder, rows):
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(str(folder / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    return sorted(con.execute(ORACLE_SQL["adjacent_chunks"]).fetchall())


def test_chunks_go_on_however_far(spark, tmp_path):
    rows = [(10, "a", 5), (480, "a", 7), (1600, "a", 13), (9000, "a", 17), (9001, "a", 30), (70, "b", 5), (120_000, "b", 5), (5, None, 5), (6, "a", None)]
    want = _parts(spark, tmp_path, rows)
    assert (10, 1600) in want and (70, 120_000) in want
    assert sorted(map(tuple, QUERIES["adjacent_chunks"](spark, str(tmp_path)).collect())) == want


def test_runs_of_chunks_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.choice("ab"), rng.randint(-9, 50)) for k in rng.sample(range(-300, 3000), 600)]
    want = _parts(spark, tmp_path, rows)
    chunks = spark.createDataFrame([(b, k, y) for k, b, y in rows], "p_brand string, id long, y int")
    for run in (7, 100, 50_000):
        assert sorted(map(tuple, lists.following_chunks(chunks, 12, run).collect())) == want
