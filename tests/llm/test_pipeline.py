"""The pipeline's stages against plain models of what each keeps, and odd rows through all of them."""

import re

import numpy as np
import pytest
from test_documents import KINDS, brute_parts, brute_print

import corpus_pipeline
from tallyplan.llm import common, decontaminate, packing, pii, quality_classifier, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_quality_stage(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    vectors, network = quality_classifier.fit(docs, labels)
    expected = set()
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        ids, _ = quality_classifier.tokens(raw, np.array([0, len(raw)]))
        v = vectors[ids].astype(float) if len(ids) else np.zeros((1, vectors.shape[1]))
        x = np.concatenate([v.mean(0), v.std(0), [np.log1p(len(ids))]])
        if network.scores(x[None].astype(np.float32).astype(float))[0] >= 0.5:
            expected.add(r.doc_id)
    kept = {r.doc_id for r in quality_classifier.keep_quality(spark, docs, DATA).collect()}
    assert len(kept ^ expected) <= 1 and 0 < len(kept) < docs.count()  # one, as sums of floats may differ in their last digits


def test_near_dedup_stage(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    part = brute_parts([brute_print(r.text) for r in rows])
    kept = sorted(r.doc_id for r in simhash.keep_firsts(spark, docs, DATA).collect())
    assert kept == sorted({rows[p].doc_id for p in part})


def test_decontamination_stage(spark, docs):
    bench = [decontaminate.normal_text(r.text).tobytes().strip() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in decontaminate.keep_uncontaminated(spark, docs, DATA).collect()}
    leaks = 0
    for r in docs.collect():
        text = decontaminate.normal_text(r.text).tobytes()
        least = min((decontaminate.edit_distance(b, text) / len(b) for b in bench), default=1)
        leaks += least <= 0.1
        assert (r.doc_id in kept) if least > 0.2 else (r.doc_id not in kept or least > 0.1)
    assert leaks


def test_redaction_stage(spark, docs):
    tables = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(spark, docs, DATA).collect()}
    changed = 0
    for r in docs.collect():
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in (tables[r.doc_id] or "").split(",") if s))
        out, at = "", 0
        for a, b, kind in sorted(spans, key=lambda s: (s[0], s[1], [k for k, _ in KINDS].index(s[2]))):
            if a >= at:
                out += r.text[at:a] + f"<{kind}>"
            at = max(at, b)
        expected = None if r.text is None else out + r.text[at:]
        assert got[r.doc_id] == (expected, None if r.text is None else len(expected))
        changed += bool(spans)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", expected or "")
    assert changed


def test_packing_stage(spark, docs):
    rows = packing.pack_stage(spark, docs, DATA).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    tokens = {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, n in tokens.items():
        own = sorted(pieces[k])
        assert [a for a, _ in own] == np.cumsum([0] + [m for _, m in own])[:-1].tolist() and sum(m for _, m in own) == n


CLASH = ["key", "id", "stay", "own", "spans", "fp", "component_id", "chunk", "group", "kept", "score", "text_key", "_key"]


def test_odd_rows_through_all_stages(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a text without a number of its own"), (None, None), (5, "Write to jane@mail.example.com now. " * 40), (5, "Write to jane@mail.example.com now. " * 40), (7, "w " * 90_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    odd = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *["x"] * len(CLASH)) for i, t in rows], schema)
    for some in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, some, DATA)
            assert out.columns == odd.columns
            kept = out.collect()
            assert len(kept) <= len(rows) and {r["key"] for r in kept} <= {"x"}
        packed = corpus_pipeline.STAGES[-1][1](spark, some, DATA)
        assert packed.where("start = 0").count() == some.count()
    # the classifier rejects by its own mind, but neither fails nor changes a row
    assert set(quality_classifier.keep_quality(spark, odd, DATA).collect()) <= set(odd.collect())
    assert len(simhash.keep_firsts(spark, odd, DATA).collect()) == 4  # no words, the text without a number, the copies, the long one
    red = pii.redact(spark, odd, DATA).where("doc_id = 5").collect()
    assert [r.text for r in red] == ["Write to <email> now. " * 40] * 2 and {r.n_chars for r in red} == {len(red[0].text)}


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == spark.read.parquet(f"{DATA}/documents.parquet").columns
        assert 0 < docs.count() <= before
        before = docs.count()
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.where("start = 0").count() == before
