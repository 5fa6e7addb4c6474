"""Operators over documents against brute force, and their defined results for odd rows."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyplan.llm import decontaminate, language_id, packing, pii, quality_classifier, quality_rules, simhash, trees
from tallyplan.llm.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 60_000), (5, "Ab cd Ef"), (5, "Ab cd Ef"), (None, "x y z"), (7, "é" * 3000), (8, "\n\n1\n1\n")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, 0.5, True) for i, t in ODD], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- quality rules


def brute_statistics(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    gone = [False] * len(w)
    for k, x in enumerate(windows):
        if windows.count(x) > 1:
            gone[k : k + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(gone)


def test_statistics(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    got = {r.doc_id: tuple(r[1:6]) for r in quality_rules.profile(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute_statistics(r.text), r.doc_id


def test_quality_rules_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (None, 0), (8, None)], "doc_id long, quality int")
    rows = quality_rules.quality_rules(odd(spark), labels).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(odd(spark).limit(0), labels.limit(0)).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.05 * rng.normal(size=3000)) > 0).astype(float)
    forest = trees.fit(x, y, {0: 1, 1: -1}, trees=25)
    grid = np.linspace(0, 1, 40)
    for a in (0.2, 0.7):
        up = forest.scores(np.stack([grid, np.full(40, a), np.full(40, 0.5)], axis=1))
        down = forest.scores(np.stack([np.full(40, a), grid, np.full(40, 0.5)], axis=1))
        assert (np.diff(up) >= -1e-12).all() and (np.diff(down) <= 1e-12).all()
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.9
    assert trees.fit(x, np.ones(3000), {}).scores(x).min() > 0.9


# --- simhash


def brute_print(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(prints):
    part = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if part[a] != part[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    low = min(part[a], part[b])
                    part = [low if p in (part[a], part[b]) else p for p in part]
                    changed = True
    return part


def test_simhash(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, DATA).collect()}
    prints = [brute_print(r.text) for r in docs]
    part = brute_parts(prints)
    for k, r in enumerate(docs):
        assert got[r.doc_id] == (f"{prints[k]:016x}", docs[part[k]].doc_id)


def test_simhash_links_of_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for c in center for _ in range(120)}
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "LARGE", 24)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    from tallyplan.llm import common

    got = {r.node % (1 << 64): r.component for r in common.components(simhash.links_of(df)).collect()}
    part = brute_parts(prints)
    for a in range(len(prints)):
        for b in range(a):
            same = prints[a] in got and prints[b] in got and got[prints[a]] == got[prints[b]]
            assert same == (part[a] == part[b])


def test_simhash_of_odd_rows(spark):
    rows = simhash.simhash(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert {r.component_id for r in rows if r.doc_id == 5} == {5}
    assert simhash.simhash(odd(spark).limit(0)).count() == 0
    kept = simhash.keep_firsts(spark, odd(spark), DATA)
    assert kept.columns == odd(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "8", "None"]


# --- decontamination


def levenshtein_in(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(60):
        p, t = (bytes(rng.integers(97, 100, rng.integers(1, 90)).tolist()) for _ in range(2))
        assert decontaminate.edit_distance(p, t) == levenshtein_in(p, t)


def test_leaks(spark):
    items = [r for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    rng = np.random.default_rng(5)
    docs, expected = [], set()
    for k, r in enumerate(items):
        text = r.text.upper() if k % 3 == 0 else r.text
        w = text.split(" ")
        for at in rng.choice(len(w), len(w) // 12, replace=False):
            w[at] = "qq" if k % 2 else w[at] + "x"
        docs.append((k, "before it all. " * 9 + "  ".join(w) + " after"))
        expected.add((k, r.item_id))
        docs.append((100 + k, r.text[: len(r.text) // 3] + " the rest is something else altogether"))
    df = spark.createDataFrame([(*d, "x") for d in docs] + [(500, None, "x"), (501, "", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(r.item_id, r.text) for r in items] + [(None, None), (900, ""), (901, "too short")], "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(0 <= r.edits <= r.item_chars * 0.2 for r in got)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0


def edited(text, share, spread, rng):
    """A text with a share of its characters edited, evenly spread substitutions or random edits of all kinds."""
    out, n = list(text), int(share * len(text))
    if spread:
        for k in range(n):
            out[int((k + 0.5) * len(text) / n)] = "q"
        return "".join(out)
    for _ in range(n):
        at = int(rng.integers(len(out)))
        out[at : at + 1] = [["q"], [], ["q", out[at]]][int(rng.integers(3))]
    return "".join(out)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("words", [6, 14, 40, 90])
def test_recall_against_plain_edit_search(share, spread, words):
    rng = np.random.default_rng(int(share * 100) + words)
    texts = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(words)) for _ in range(60)]
    items = decontaminate.Items(tuple(enumerate(texts)))
    docs = ["the left part " + edited(t, share, spread, rng) + " right" for t in texts]
    buffer, offsets = np.frombuffer("".join(docs).encode(), np.uint8), np.cumsum([0] + [len(d) for d in docs])
    expected = {}
    for d, doc in enumerate(docs):
        edits = decontaminate.edit_distance(texts[d].encode(), doc.encode())
        if edits <= int(0.2 * len(texts[d]) + 1e-9):
            expected[d, d] = edits
    got = items.leaks(buffer, offsets)
    assert len(expected) > 20 and set(got.items()) <= set(expected.items())
    assert len(got) >= 0.9 * len(expected)
    assert share > 0.1 or len(got) >= 0.95 * len(expected)


def test_long_item_and_text(monkeypatch):
    rng = np.random.default_rng(4)
    long = " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(8_000))
    items = decontaminate.Items(((1, long), (2, "a small item of seven words in all")))
    docs = ["left " + edited(long, 0.05, False, rng) + " right", long[:4_000], "x" * 50_000, "the " * 20_000]
    buffer, offsets = np.frombuffer("".join(docs).encode(), np.uint8), np.cumsum([0] + [len(d) for d in docs])
    assert set(items.leaks(buffer, offsets)) == {(0, 0)}


def test_a_large_benchmark_is_searched_in_passes(spark, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 4_000)
    assert whole and {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()} == whole


# --- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op6_packing"](spark, DATA).collect()
    import zlib

    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = np.array(plain.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_sequence) * 2048 - total < 0.05 * total + 2048


@pytest.mark.parametrize("partitions", [1, 16, 211])
def test_padding_does_not_depend_on_partitions(spark, partitions):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = packing.pack(docs.repartition(partitions)).collect()
    used = sum(r.length for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == (np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]).tolist()
    assert len(by_sequence) * 2048 - used < 0.03 * used and max(o + n for p in by_sequence.values() for o, n in p) <= 2048


def test_groups_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    docs = spark.createDataFrame([(k, "some words to pack " * (k % 40)) for k in range(400)], "doc_id long, text string")
    rows = packing.pack(docs, window=64).collect()
    total = {}
    for r in rows:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert sum(total.values()) == sum(r.doc_tokens for r in rows if r.start == 0) and max(total.values()) <= 64
    assert len({s >> 33 for s in total if s % 2}) > 4


def test_words_are_remembered_in_turn(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    encoder, plain = packing.WordEncoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for k in range(30):
        text = " ".join(f"word{chr(97 + (k * j) % 26)}{'.' if j % 3 else ''} stemm{chr(97 + j % 26)}," for j in range(15)) + " " + "é" * 60 + ". " + "y" * 70
        assert np.frombuffer(encoder([text.encode()])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids + [1]
    assert len(encoder.recent) <= 20


def test_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = ["<|endoftext|> hi <|ENDOFTEXT|>", "Don't STOP it's it''s x,y. z!!", "Été İstanbul ΣΑΣ ﬁ ½ ①² \U0001f600‍", "a\x0bb\x1cc\x85d e", "", "中文字 ไทย é", "x" * 400]
    got = packing.encoder(path)([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids + [1]


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 65, 300)
    where, offset = packing.best_fit_decreasing(lengths, 64)
    room = []
    for k in sorted(range(300), key=lambda k: -lengths[k]):
        fit = [r for r in room if r >= lengths[k]]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - lengths[k])
        else:
            room.append(64 - lengths[k])
    assert where.max() + 1 == len(room)
    for s in range(where.max() + 1):
        parts = sorted(np.flatnonzero(where == s), key=lambda k: offset[k])
        assert offset[parts].tolist() == (np.cumsum(lengths[parts]) - lengths[parts]).tolist() and lengths[parts].sum() <= 64


def test_packing_of_odd_rows(spark):
    rows = packing.pack(odd(spark)).collect()
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1} and sum(r.start == 0 for r in rows) == len(ODD)
    assert packing.pack(odd(spark).limit(0)).count() == 0


# --- personal data

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    counts, out = [], []
    for kind, pattern in KINDS:
        spans = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(spans))
        out += spans
    return counts, hashlib.sha256(",".join(out).encode()).hexdigest(), out


TRICKY = [
    "a@b.c@d.e", "a@b.c_d@e.f x@y z@w.q.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.0255", "4111 1111-1111 1111 1 4111111111111111", "+1 (942) 555-5253 +12 +1((((12345678", "é\U0001f600 +49 30 1234567 \U0001f600a.b@c-d.ef",
    "4111111111111111@x.yz 4111111111111111.1.1.1", "..@a.b.c..d", "a" * 3000 + "@", "1" * 5000, "1." * 900, "+" * 400 + "1 2 3 4 5 6 7 8 9", None, "",
]


def test_base_spans(spark):
    docs = [(k, t) for k, t in enumerate(TRICKY)] + [(1, TRICKY[1])]
    rows = pii.personal_data(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts, sha, spans = brute_spans(TRICKY[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == sha, TRICKY[r.doc_id][:60]
        assert set(spans) <= set(r.spans.split(",")) | {""}
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_discover_identifiers(spark):
    texts = [f"word{k} please write to user{k}@mail.example.com today" for k in range(9)] + ["you may please write to jane9(at)corp today", "it has been 9999999 days since"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert rows[9].n_email == 0 and rows[9].spans.startswith("email:24:") and rows[10].spans == ""
    red = {r.doc_id: r.text for r in pii.redact(spark, docs, DATA).collect()}
    assert red[0] == "word0 please write to <email> today" and "<email>" in red[9] and red[10] == texts[10]


def test_pii_is_native(spark):
    plan = QUERIES["op7_pii"](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- language and quality


def test_language(spark):
    rows = QUERIES["op9_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 10 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    learn = spark.createDataFrame([(k, "the of and in " * 20, "en") for k in range(20)] + [(k + 50, "der die und das " * 20, "de") for k in range(20)], "doc_id long, text string, lang string")
    rows = language_id.identify(odd(spark), learn).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 8)} == {"und"} and {r.lang_pred for r in rows if r.doc_id == 5} <= {"en", "de"}
    assert {r.lang_pred for r in language_id.identify(odd(spark), learn.limit(0)).collect()} == {"und"}
    mixed = language_id.identify(spark.createDataFrame([(1, "der und die das " * 9 + "the of and " * 2), (2, "12 34 ٣"), (3, "٣ ب")], "doc_id long, text string"), learn).collect()
    assert {r.doc_id: r.lang_pred for r in mixed}[1] == "de" and {r.doc_id: r.lang_pred for r in mixed}[2] == "und"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    scores, counts = rng.normal(size=(7, 3)), np.array([0, 4, 3])
    stay = np.exp(rng.normal(size=(3, 3)))
    pairs, both = np.zeros((3, 3)), np.zeros((3, 3))
    got = language_id.marginals(scores, counts, stay, pairs)
    import itertools

    for a, n in ((0, 4), (4, 3)):
        mass, joint = np.zeros((n, 3)), np.zeros((n - 1, 3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.prod([np.exp(scores[a + k, s]) for k, s in enumerate(path)]) * np.prod([stay[x, y] for x, y in zip(path, path[1:], strict=False)])
            for k, s in enumerate(path):
                mass[k, s] += p
                if k:
                    joint[k - 1, path[k - 1], s] += p
        assert np.allclose(got[a : a + n], mass / mass.sum(axis=1, keepdims=True))
        both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    assert np.allclose(pairs, both)


def test_stretches_come_from_whole_texts(spark):
    texts = [" ".join(f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)}" for k in range(n)) for n in (3, 192, 5000)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "lang": "x", "text": t} for k, t in enumerate([*texts, "", None, "12"])], pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())]))
    rows = [r for b in language_id._stretches([batch]) for r in b.to_pylist()]
    by_doc = {k: [r["text"].decode() for r in rows if r["doc_id"] == k] for k in range(6)}
    assert by_doc[0] == [texts[0]] and " ".join(by_doc[1]) == texts[1] and len(by_doc[2]) == language_id.STRETCHES
    assert texts[2].startswith(by_doc[2][0]) and texts[2].endswith(by_doc[2][-1]) and not by_doc[3] + by_doc[4] + by_doc[5]


def test_short_and_rare_languages_are_learned(spark):
    rows = [(k, "the of and thing with word " * 9, "aa") for k in range(300)] + [(1000 + k, "oui non", "bb") for k in range(6)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(spark.createDataFrame([(1, "non oui oui"), (2, "with the thing")], "doc_id long, text string"), learn, sample_docs=40).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "bb", 2: "aa"}


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    assert all(r.predicted == (1 if r.score >= 0.5 else 0) for r in rows)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 0)], "doc_id long, quality int")
    rows = quality_classifier.quality_scores(odd(spark), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.quality_scores(odd(spark).limit(0), labels.limit(0)).count() == 0
    kept = quality_classifier.keep_quality(spark, odd(spark), "/root/testdata/sf0.001")
    assert kept.schema.names == odd(spark).schema.names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(name):
    assert callable(QUERIES[name])


_ = F
