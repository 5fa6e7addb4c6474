"""SimHash near-duplicates: deletion-variant signatures over two halves of the fingerprint, an equality join, and a check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C

SHINGLE_WORDS = 3
#: Two fingerprints link at this many differing bits or fewer: over two halves, one half then differs by one bit at most.
DISTANCE = 3
#: Members of a bucket that are compared in one task; larger buckets are divided again by the other half.
LARGE = 4_096
#: Rows of compared members at once.
TILE = 512

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 (seed 42) of the three-word shingles of A-Z-lowered text, repeats included; of all its words if they are fewer."""
    from xxhash import xxh64_intdigest as digest

    words = text.translate(_LOWER).split()  # bytes.split parts at exactly space and 9 to 13
    if not words:
        return []
    joined = b" ".join(words)
    n = len(words)
    if n <= SHINGLE_WORDS:
        return [digest(joined, 42)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
    return [digest(joined[a:b], 42) for a, b in zip([0, *[e + 1 for e in ends[: n - SHINGLE_WORDS]]], ends[SHINGLE_WORDS - 1 :], strict=True)]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes: bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    firsts = (np.cumsum(counts) - counts)[full]
    votes = np.zeros((len(full), 64), dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        hi = min(len(hashes), lo + (1 << 16))
        bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        some = np.flatnonzero((firsts < hi) & (firsts + counts[full] > lo))
        votes[some] += np.add.reduceat(bits, np.maximum(firsts[some], lo) - lo, axis=0, dtype=np.int32)
    on = votes * 2 > counts[full][:, None]
    out[full] = np.packbits(on, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows, buf, offsets in C.text_blocks(batch):
            raw = buf.tobytes()
            lists = [shingle_hashes(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts = np.array([len(x) for x in lists], dtype=np.int64)
            flat = np.array([h for x in lists for h in x], dtype=np.uint64)
            prints = fingerprints(flat, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(prints), *(batch.column(c).slice(first, rows) for c in batch.schema.names[2:])], ["doc_id", "fp", *batch.schema.names[2:]])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One-wildcard variants of both halves: half, wildcard and the other 31 bits make the key."""
    wild = np.arange(32, dtype=np.uint64)
    for batch in batches:
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        for lo in range(0, len(fp), 4096):
            part = fp[lo : lo + 4096]
            keys = np.concatenate([(np.uint64(half) << np.uint64(37)) | (wild[None, :] << np.uint64(32)) | (value[:, None] & ~(np.uint64(1) << wild[None, :])) for half, value in enumerate((part >> np.uint64(32), part & np.uint64(0xFFFFFFFF)))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, 64).view(np.int64))], ["key", "fp"])


def _subvariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For members of a large bucket: one-wildcard variants of both quarters of the half that the bucket's key leaves open.

    That half differs by three bits at most, so one of its quarters differs by one at most. 46 bits are then given, and a
    bucket has at most 2^18 members.
    """
    wild = np.arange(16, dtype=np.uint64)
    for batch in batches:
        key, fp = (np.asarray(batch.column(c)).view(np.uint64) for c in ("key", "fp"))
        for lo in range(0, len(fp), 4096):
            k, f = key[lo : lo + 4096], fp[lo : lo + 4096]
            other = np.where(k >> np.uint64(37) == 0, f & np.uint64(0xFFFFFFFF), f >> np.uint64(32))
            keys = np.concatenate([(k[:, None] << np.uint64(21)) | (np.uint64(quarter) << np.uint64(20)) | (wild[None, :] << np.uint64(16)) | (value[:, None] & ~(np.uint64(1) << wild[None, :])) for quarter, value in enumerate((other >> np.uint64(16), other & np.uint64(0xFFFF)))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(f, 32).view(np.int64))], ["key", "fp"])


def _star(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members as their distances of at most DISTANCE do, each to its part's first member."""
    n = len(fp)
    part = np.arange(n)
    while True:
        low = part.copy()
        for a in range(0, n, TILE):
            for b in range(0, n, 4096):
                near = np.bitwise_count(fp[a : a + TILE, None] ^ fp[None, b : b + 4096]) <= DISTANCE
                low[a : a + TILE] = np.minimum(low[a : a + TILE], np.where(near, part[None, b : b + 4096], n).min(axis=1))
        low = low[low]
        if (low == part).all():
            break
        part = low
    apart = part != np.arange(n)
    return fp[apart], fp[part[apart]]


def _link(large: int | None):
    """Over rows sorted by key: links inside the keys' runs, as (a, b, false); members of runs over ``large`` as (fp, key, true)."""

    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([cut, [len(key)]]))
        a, b = [], []
        small = np.repeat(size <= 16, size)
        for step in range(1, min(16, int(size.max()))):
            at = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
            near = np.bitwise_count(fp[at] ^ fp[at + step]) <= DISTANCE
            a.append(fp[at][near]), b.append(fp[at + step][near])
        for s in np.flatnonzero(size > 16):
            x, y = _star(fp[cut[s] : cut[s] + size[s]])
            a.append(x), b.append(y)
        if not a:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def out(a: np.ndarray, b: np.ndarray, big: bool) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(a), 10_000):
            x, y = a[lo : lo + 10_000], b[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(x), big))], ["a", "b", "big"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, rows, passing = [], [], 0, None
        for batch in batches:
            key, fp = (np.asarray(batch.column(c)).view(np.uint64) for c in ("key", "fp"))
            if passing is not None:  # inside a run that is too large
                n = int(np.searchsorted(key != passing, True)) if (key == passing).any() else 0
                yield from out(fp[:n], key[:n], True)
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                passing = None
            keys.append(key), prints.append(fp)
            rows += len(key)
            if rows < 200_000:
                continue
            key, fp = np.concatenate(keys), np.concatenate(prints)
            last = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            yield from divided(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if large and len(key) > large:
                passing = key[0]
                yield from out(fp, key, True)
                key, fp = key[:0], fp[:0]
            keys, prints, rows = [key], [fp], len(key)
        if rows:
            yield from divided(np.concatenate(keys), np.concatenate(prints))

    def divided(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if large and len(key):
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([cut, [len(key)]]))
            over = np.repeat(size > large, size)
            yield from out(fp[over], key[over], True)
            key, fp = key[~over], fp[~over]
        if len(key):
            yield from out(*links(key, fp), False)

    return run


def links_of(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``prints(fp)`` exactly as their distances do."""
    keyed = prints.mapInArrow(_variants, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    first = C.materialize(keyed.mapInArrow(_link(LARGE), "a long, b long, big boolean"), "simhash-links")
    links = first.where("not big").select("a", "b")
    if first.where("big").limit(1).count():
        again = first.where("big").selectExpr("b as key", "a as fp").mapInArrow(_subvariants, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
        links = links.unionByName(again.mapInArrow(_link(None), "a long, b long, big boolean").select("a", "b"))
    return links


def simhash(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, fp (long), component_id and the carried columns of every row of ``docs(doc_id, text, ...)``.

    A null or empty text has no shingle: its fingerprint is zero and links like any other. Repeated rows share their
    fingerprint and so their component. A component's id is its smallest non-null doc_id; an empty table gives no rows.
    """
    prints = docs.select(F.col("doc_id").cast("long"), "text", *carry)
    kinds = ", ".join(f"{c} {dict(prints.dtypes)[c]}" for c in carry)
    prints = C.materialize(prints.mapInArrow(_fingerprint, "doc_id long, fp long" + (f", {kinds}" if carry else "")), "simhash")
    firsts = C.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    parts = C.components(links_of(firsts.select("fp")))
    joined = firsts.join(parts, firsts["fp"] == parts["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    ids = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(joined.join(ids, "component").select("fp", "component_id"), "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash(C.documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_firsts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group, the row of the smallest doc_id stays (of equal ids that of the smallest text hash).

    A null or empty text is a member of the group of fingerprint zero; a null doc_id stays only in a group without others;
    of rows that repeat in full one stays; very long texts count whole; an empty table gives no rows; further columns pass,
    whatever their names.
    """
    key, id_, stay_ = C.fresh_names(docs, "key", "id", "stay")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    groups = simhash(keyed.select("doc_id", "text", F.col(key).alias("text_key")), "text_key")
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    # rows without any doc_id in their whole group have no component id; they are told apart by fingerprint
    loose = groups.where("component_id is null").groupBy("fp").agg(F.min("text_key").alias(stay_)).select(F.lit(None).cast("long").alias(id_), stay_)
    stay = C.materialize(best.where("component_id is not null").select(F.col("best.doc_id").alias(id_), F.col("best.text_key").alias(stay_)).unionByName(loose), "simhash-stay")
    twice = groups.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    kept = keyed.join(stay, keyed["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(stay_)), "left_semi")
    return (kept.dropDuplicates(["doc_id", key]) if twice else kept).drop(key)
