"""The manifest against a plain tree in Python and, whole tables, against SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyplan.llm import merkle as M
from tallyplan.llm import oracle

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(level):
    """(root, siblings of each leaf as (left, right) by level)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        groups = [level[k : k + 8] for k in range(0, len(level), 8)]
        for i, a in enumerate(at):
            g, j = groups[a // 8], a % 8
            paths[i].append(("".join(g[:j]), "".join(g[j + 1 :])))
        at, level = [a // 8 for a in at], [h("".join(g)) for g in groups]
    return level[0], paths


def plain(rows):
    """Result rows by brute force."""
    leaf = lambda r, text: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)))
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for lang in langs}
    climbed = {lang: climb([leaf(r, r[4]) for r in t]) for lang, t in trees.items()}
    root, tops = climb([climbed[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        subroot, paths = climbed[lang]
        for k, (r, path) in enumerate(zip(trees[lang], paths, strict=True)):
            claim = lower(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
            folded = leaf(r, claim)
            for left, right in path + top:
                folded = h(left + folded + right)
            out.append((r[0], lang, k, leaf(r, r[4]), subroot, root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return out


def same(got, rows):
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def test_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(oracle.OP13)
    names = [x[0] for x in want.description]
    got = M.op13_merkle_manifest(spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select(*M.FIELDS).collect()]
    same(got.collect(), docs)


@pytest.mark.parametrize("partitions", [1, 7])
def test_sizes(spark, partitions):
    """Trees around the powers of the fan-out, blocks of 64, over few and many ranges."""
    rng = np.random.default_rng(partitions)
    rows = [(int(i), "s", lang, int(i), f"Text {i}") for lang, n in (("a", 1), ("b", 8), ("c", 9), ("d", 64), ("e", 65), ("é", 600), ("f", 7)) for i in rng.permutation(n)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(M.merkle_documents(spark.createDataFrame(rows, KIND), block=2).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "s", None, 3, "ABC"), (5, "s", "", 1, ""), (5, "s", "", 1, "A"), (5, "s", "", 1, "A"), (-7, "a1:b", "x", 0, "-"), (9, "s", "x", None, "Ünï " * 50_000), (10, "s", "X", 2, "é"),
        *([(3, "s", "hot", 1, "Same Text")] * 300), *((k, "s", f"l{k}", 1, "One") for k in range(70)),
    ]
    df = spark.createDataFrame(rows, KIND).withColumn("tree", F.lit("t")).withColumn("leaf", F.lit(1)).withColumn("idx", F.lit(2)).withColumn("spread", F.lit(3))
    same(M.merkle_documents(df).collect(), rows)
    assert M.merkle_documents(df.limit(0)).count() == 0
    one = M.merkle_documents(spark.createDataFrame([(6, "s", "en", 2, "Hi")], KIND)).collect()
    same(one, [(6, "s", "en", 2, "Hi")])
    assert one[0].subroot == one[0].root == one[0].leaf and one[0].proof_sha256 == h("")


@pytest.mark.parametrize("seed", range(6))
def test_runs_cut_anywhere(spark, seed):
    """However the leaves are cut into runs, peaks and merged edges give the tree's nodes, each of them once."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 700))
    leaves = [h(str(k)) for k in range(n)]
    cuts = sorted({0, n, *rng.integers(0, n + 1, rng.integers(0, 12)).tolist()})
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        run = M.Mountains("t", n, a, out)
        for k in range(a, b, 5):
            run.push(leaves[k : min(k + 5, b)])
        run.end()
    depth = next(k for k in range(9) if 8**k >= n)
    edges = spark.createDataFrame(out, M._NODES).where("edge")
    made = [tuple(r) for df in M.merge_edges(edges, depth) for r in df.select("level", "idx", "digest").collect()]
    held = {(x[2], x[3]): x[4] for x in out}
    assert len(held) == len(out) and not set(held) & {r[:2] for r in made}
    nodes = held | {r[:2]: r[2] for r in made}
    level = leaves
    for k in range(depth + 1):
        for i, d in enumerate(level):
            assert nodes.get((k, i), d) == d
        if k == depth:
            assert nodes[k, 0] == level[0] and len(level) == 1
        level = [h("".join(level[j : j + 8])) for j in range(0, len(level), 8)]
    size = -(-n // 8**depth)
    assert size == 1 and all(i < -(-n // 8**k) for k, i in nodes)
