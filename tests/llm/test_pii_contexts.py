"""Contexts of identifiers next to one another, at a text's start and of any length."""

from pyspark.sql import functions as F

from tallyplan.llm import pii

DATA = "/root/testdata/sf0.001"


def test_contexts_beside_tokens_and_at_the_start(spark):
    texts = [f"ids: user{k}@mail.example.com, other{k}@mail.example.com" for k in range(9)] + ["ids: jane9(at)corp, b29385(at)corp"]
    texts += [f"room {k} contact: some{k}@mail.example.com" for k in range(9)] + ["Contact: jane8(at)corp today", "room 12: jane7(at)corp"]
    texts += [f"room {k}: more{k}@mail.example.com" for k in range(9)] + ["please send it to key " + "k1" * 60]
    texts += [f"please send it to key a{k}@mail.example.com" for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    red = {r.doc_id: r.text for r in pii.redact(spark, docs, DATA).collect()}
    assert red[9] == "ids: <email>, <email>"
    assert red[19] == "Contact: <email> today" and red[20] == "room 12: <email>"
    assert red[30] == "please send it to key <email>"


def test_many_matches_in_one_text(spark):
    import re

    n = 3_000
    text = " ".join(f"a{k}@b.example" if k % 2 else f"é key {k}x" for k in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = df.select(pii.found(F.col("text"), pii.PATTERNS["email"]).alias("s"), pii.candidates(F.col("text")).alias("c")).first()
    assert [(s.start, s.end, s.match) for s in row.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    assert len(row.c) == n and [text[c.start : c.end] for c in row.c] == [c.token for c in row.c]
    assert row.c[0].context == "é key" and row.c[1].context == f"key {pii.EARLIER}" and row.c[2].context == "é key"
