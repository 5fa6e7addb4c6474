"""Texts that are made to have one polynomial hash (Thue-Morse words and their complements) are still told apart."""

import hashlib

import numpy as np

from tallyplan.llm import common as C
from tallyplan.llm import quality_rules, suffix_array, suffix_tree

ONE = "a"
while len(ONE) < 2048:
    ONE += ONE.translate({97: 98, 98: 97})
OTHER = ONE.translate({97: 98, 98: 97})


def test_the_words_do_collide():
    buf = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    h = C.range_hash(C.byte_sums(buf), np.array([0, 2048]), np.array([2048, 4096]))
    assert h[0] == h[1] and ONE != OTHER


def test_classes_equal_a_dictionary():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    sizes = rng.integers(0, 14, 3000)
    content = [data[a : a + n].tobytes() for a, n in zip(starts, sizes)]
    for bits in (0xFF, 3):  # a good hash, and one that meets often
        h = np.array([int(hashlib.md5(c).hexdigest()[:4], 16) & bits for c in content])
        first, inverse = C.exact_classes(h, data, starts, sizes)
        assert len(first) == len(set(content)) and all(content[first[k]] == c for k, c in zip(inverse, content))


def test_lines_words_and_windows_are_compared():
    words = " ".join(f"w{k}" for k in range(9))
    text = f"{ONE}\n{OTHER}\n{words} {ONE} {words} {OTHER} end of it"
    buf = np.frombuffer(text.encode(), np.uint8)
    counts, features = quality_rules.statistics(buf, np.array([0, len(buf)]))
    got = dict(zip(quality_rules.COUNTS, counts[0].tolist()))
    assert got["n_dup_lines"] == 0 and got["n_repeat_words"] == 18
    assert round(features[0][quality_rules.FEATURES.index("distinct_share")] * got["n_words"]) == 14


def test_passages_are_compared(spark):
    left, right = " ".join(f"l{k}" for k in range(17)), " ".join(f"r{k}" for k in range(17))
    docs = spark.createDataFrame([(1, f"{left} {ONE} {right}"), (2, f"{left} {OTHER} {right}"), (3, f"{left} mid {right}"), (4, f"{left}  mid\n{right}")], "doc_id long, text string").coalesce(1)
    kept = {r.doc_id: len(r.text.split()) for r in suffix_tree.dedup_words(docs).collect()}
    assert kept == {1: 35, 2: 35, 3: 0, 4: 0}
    for bad in (1, 2):
        out = {r.doc_id: bytes(r.kept) for r in suffix_array.dedup_bytes(spark.createDataFrame([(0, ONE), (bad, OTHER[:700])], "doc_id long, text string")).collect()}
        windows = {ONE[k : k + 50] for k in range(len(ONE) - 49)}
        gone = set()
        for k in range(651):
            if OTHER[k : k + 50] in windows:
                gone |= set(range(k, k + 50))
        assert out[bad] == "".join(c for k, c in enumerate(OTHER[:700]) if k not in gone).encode()
