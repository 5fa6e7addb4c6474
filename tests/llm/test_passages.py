"""The two passage operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tallyplan.llm import passages, suffix_array, suffix_tree

WORDS = "doc_id long, n_words long, n_removed long, kept_sha256 string"
BYTES = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def brute_words(docs, n=35):
    seen = collections.Counter()
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for w in split:
        seen.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(docs, n=50):
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            if i is not None:
                least[b[k : k + n]] = min(least.get(b[k : k + n], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if i is not None and least[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(4)
    base = [" ".join(rng.choice(["ab", "c", "dd", "e"]) for _ in range(120)) for _ in range(6)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            x, a = rng.choice(base).split(), rng.randint(0, 100)
            parts.append(" ".join(x[a : a + rng.randint(1, 90)]))
        out.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return out + [(200, None), (201, ""), (202, "a " * 500), (203, "a " * 100), (204, "é" * 300), (205, "é" * 80), (205, base[0]), (205, base[0]), (206, "\0" * 120), (207, "\0" * 60), (-3, base[1])]


def test_synthetic(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows()], "doc_id long, text string, chunk string, size int").repartition(3)
    got = sorted(map(tuple, suffix_tree._removed(docs, suffix_tree._finish, WORDS).collect()), key=repr)
    assert got == brute_words(rows())
    got = sorted(map(tuple, suffix_array._removed(docs, suffix_array._finish, BYTES).collect()), key=repr)
    assert got == brute_bytes(rows())


def test_nulls_and_texts(spark):
    text = "one two three four five six seven eight nine ten " * 1 + " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text), (5, text + " tail"), (6, "own " + text)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_tree.dedup_words(docs).collect()}
    assert got == {None: "", 5: "tail", 6: "own"}
    got = {r.doc_id: bytes(r.kept) for r in suffix_array.dedup_bytes(docs).collect()}
    assert got[None] == text.encode() and got[5] == (text + " tail").encode() and got[6].strip() == b"own"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.dedup_words(docs).count() == 0
    assert suffix_array.dedup_bytes(docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([np.append(rng.integers(97, 99, 40), 0) for _ in range(30)]).astype(np.uint8)
    raw = text.tobytes()
    order, classes = suffix_array.shared_prefixes(text, 9)
    by = collections.defaultdict(set)
    for k, c in zip(order, classes, strict=True):
        if b"\0" not in raw[k : k + 9] and k + 9 <= len(raw):
            by[int(c)].add(raw[k : k + 9])
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({next(iter(v)) for v in by.values()})


def test_prefix_parts_hold_every_repeat():
    rng = np.random.default_rng(1)
    ranks = rng.integers(1, 3, 4000)
    suffixes = np.arange(3900)
    pairs = collections.Counter(tuple(ranks[k : k + 12]) for k in suffixes)
    deep = set()
    parts, alone = suffix_tree.prefix_parts(ranks, suffixes, 64, 12)
    assert sorted(np.concatenate([alone, *(p for p, _ in parts)]).tolist()) == suffixes.tolist()
    assert all(pairs[tuple(ranks[k : k + 12])] == 1 for k in alone.tolist())
    for part, shared in parts:
        leaves, node = suffix_tree.deep_nodes(ranks, part, shared, 12)
        deep |= set(leaves[np.bincount(node)[node] > 1].tolist())
    assert deep == {k for k in suffixes.tolist() if pairs[tuple(ranks[k : k + 12])] > 1}


@pytest.mark.parametrize("kind", ["tree", "transform"])
def test_all_comes_from_the_index(spark, monkeypatch, kind):
    """Without the tree's weights, or with a transform whose rows are all apart, nothing goes, copies included."""
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text) for k in range(5)] + [(9, "left " + text + " right")], "doc_id long, text string")
    if kind == "tree":
        kept = suffix_tree.dedup_words(docs)
        assert {len(r.text) for r in kept.where("doc_id < 9").collect()} == {0}
        monkeypatch.setattr(suffix_tree, "judge", lambda group: np.zeros(int(group.count.sum()), bool))
        assert suffix_tree.dedup_words(docs).where(f"length(text) >= {len(text)}").count() == 6
    else:
        assert {len(r.kept) for r in suffix_array.dedup_bytes(docs).where("doc_id between 1 and 8").collect()} == {0}


def test_planes():
    a = np.array([1, 70_000, 2**40, 5], dtype=np.uint64)
    assert (passages.expand(passages.squeeze(a), 4, np.uint64) == a).all()


@pytest.mark.parametrize("name", ["op1_suffix_tree", "op4_suffix_array"])
def test_equals_sql(spark, name):
    import duckdb

    from tallyplan.llm.catalogue import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    df = QUERIES[name](spark, data)
    got = con.execute(ORACLE_SQL[name])
    assert [x[0] for x in got.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(got.fetchall())


@pytest.mark.parametrize("kind", ["tree", "transform"])
def test_frequent_anchors_are_divided(spark, kind):
    """Near copies over many chunks: the result doesn't depend on when an anchor counts as frequent."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.integers(0, 90, 2):
            own[at] = f"x{rng.integers(5)}"
        texts.append(" ".join(own[int(rng.integers(3)) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if kind == "tree":
        args = ("t", passages.Words, suffix_tree.judge, suffix_tree._finish_text, "doc_id long, text string", False, suffix_tree.PACK_BYTES)
    else:
        args = ("a", passages.Bytes, suffix_array.judge, suffix_array._finish_text, "doc_id long, kept binary", True, suffix_array.PACK_BYTES)
    plain = sorted((r[0], bytes(r[1]) if kind == "transform" else r[1]) for r in passages.remove(docs, *args).collect())
    for hot in (0, 3):
        divided = passages.remove(docs, *args, chunk_bytes=900, hot_chunks=hot)
        assert sorted((r[0], bytes(r[1]) if kind == "transform" else r[1]) for r in divided.collect()) == plain
    assert sum(len(t) for _, t in plain) < sum(map(len, texts)) * 0.8
