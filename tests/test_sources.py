import json

from pyspark.sql import functions as F

from tallyplan.sources import snapshots, xlsx
from tallyplan.streaming import progress


def test_workbook_round_trip(spark):
    report = spark.createDataFrame([("Lamp <A>", 12), ("Ąć & b", 3)], "label string, n long").orderBy(F.desc("n"))
    content = xlsx.export(report, "n", "Take-off", {"Project": "P"})
    assert content[:2] == b"PK"
    assert xlsx.read(content) == [["label", "n"], ["Lamp <A>", 12], ["Ąć & b", 3], ["TOTAL", 15]]
    assert xlsx.display_time("2024-05-01T10:00:00Z") == "2024-05-01 10:00 UTC" and xlsx.display_time("x") == "x"


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "boxes": [{"symbolName": "01_A", "x": 1, "y": 2, "width": 3, "height": 4}, {"symbol_name": "02_B", "x": 5}], "performance": {"backendTimingsMs": {"scan": 5.0, "total": 9.0, "post": 7.0}}}))
    (tmp_path / "b.json").write_text("{broken")
    snaps = snapshots.read_snapshots(spark, str(tmp_path))
    assert snaps.count() == 2
    assert sorted(r.symbol for r in snapshots.boxes_of(snaps).collect()) == ["01_A", "02_B"]
    assert [r.stage for r in snapshots.slowest_stages(snaps).orderBy("place").collect()] == ["post", "scan"]
    row = spark.range(1).select(snapshots.label_json(snapshots.label_map(F.lit('{"b":"2","a":"1","c":" "}'))).alias("j")).first()
    assert row.j == '{"a":"1","b":"2"}'
    names = snapshots.append_names(spark.createDataFrame([("07_x",)], "name string"), spark.createDataFrame([(1, "lamp a"), (2, "b")], "ordinal long, label string"))
    assert [r.name for r in names.orderBy("ordinal").collect()] == ["08_lamp_a", "09_b"]


def test_stream_sessions(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:10:00"), (3, 7, "2024-01-01 05:00:00"), (4, 8, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = progress.sessions(stream, "user_id", "ts").writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("sessions_out").collect()) == [(7, 1), (7, 2)]
