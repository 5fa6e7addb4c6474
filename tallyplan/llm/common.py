"""Shared pieces of the corpus operators: shared storage, text batches and vectorised byte kernels."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; bounds their temporaries.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW = {"n": 0}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a local session gets a folder of its own (tests);
    on a cluster that is an error, for driver and executors would each write to their own disk."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(root)
        return root
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    import tempfile

    root = tempfile.mkdtemp(prefix="tallyplan-")
    context.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and a lost executor costs no more than one stage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a materialized table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES):
    """Yields (first row, rows, bytes as uint8, offsets from 0) of slices of about ``limit`` bytes; a null text has no bytes.

    A document is never divided, so one longer than ``limit`` makes a slice of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()) if not pa.types.is_string(col.type) and not pa.types.is_binary(col.type) else col, np.int32
    n = len(col)
    if not n:
        return
    valid = np.asarray(col.is_valid())
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        at = offsets[first : last + 1]
        if valid[first:last].all():
            yield first, last - first, data[at[0] : at[-1]], at - at[0]
        else:
            sizes = np.where(valid[first:last], np.diff(at), 0)
            keep = [data[at[i] : at[i + 1]] for i in range(last - first) if sizes[i]]
            yield first, last - first, np.concatenate(keep) if keep else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        first = last


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; none crosses a document's end."""
    return run_bounds(~_SPACE[buf], offsets)


def run_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets[:-1]] = True
    cut[n] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        n = max(n, BLOCK_BYTES + 1024)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _POW[key] = np.multiply.accumulate(table)
        _POW["n"] = n
    return _POW["up"], _POW["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of a base, modulo 2^64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def byte_sums(buf: np.ndarray, keys: np.ndarray = _BYTE_KEYS) -> np.ndarray:
    return prefix_sums(keys[buf])


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges; equal content gives equal hashes wherever it stands. Lengths count.

    Different content may meet, and can be made to: where a match decides a result, exact_classes compares the content.
    """
    _, down = powers(len(sums))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407))


def exact_classes(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first member of each class, class of each element) of the ranges of ``data``: those with one content make a class.

    Equal ranges must have equal hashes. Ranges of one hash are compared, so that a hash never decides; those that differ
    are told apart by their content.
    """
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    other = _differing(data, starts, sizes, first[inverse])
    if not len(other):
        return first, inverse
    label = inverse.astype(np.int64)
    seen: dict[tuple[int, bytes], int] = {}
    for k in np.flatnonzero(np.isin(inverse, inverse[other])).tolist():
        label[k] = len(first) + seen.setdefault((int(inverse[k]), data[starts[k] : starts[k] + sizes[k]].tobytes()), len(seen))
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return first, inverse


def _differing(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Elements whose range isn't equal to that of the element ``like`` names."""
    apart = np.flatnonzero(like != np.arange(len(like)))
    out = [apart[sizes[apart] != sizes[like[apart]]]]
    apart = apart[sizes[apart] == sizes[like[apart]]]
    apart = apart[sizes[apart] > 0]
    if data.dtype == np.uint8 and len(data) >= 8 and len(apart):  # eight bytes at a time, the last eight over again
        wide = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), 0, (1,))
        short = sizes[apart] < 8
        groups = [(data, apart[short], sizes[apart[short]], 1), (wide, apart[~short], (sizes[apart[~short]] + 7) // 8, 8)]
    else:
        groups = [(data, apart, sizes[apart], 1)]
    for source, some, counts, step in groups:
        ends = np.cumsum(counts)
        at = 0
        while at < len(some):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + (1 << 18), side="right")))
            part, n = some[at:to], counts[at:to]
            inside = ragged(np.zeros(len(part), np.int64), n) * step
            if step > 1:
                inside = np.minimum(inside, np.repeat(sizes[part] - step, n))
            a, b = np.repeat(starts[part], n) + inside, np.repeat(starts[like[part]], n) + inside
            bad = source[a] != source[b]
            if bad.any():
                out.append(np.unique(np.repeat(part, n)[bad]))
            at = to
    return np.concatenate(out)


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of 0/1 flags between offsets."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document of each position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(starts - firsts, lengths) + np.arange(total)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, component), the component being its smallest node.

    Alternating large-star and small-star steps; every round is written to the shared folder, so neither
    links nor components ever meet on the driver or grow a lineage. Nodes without a link aren't returned.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(rounds):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = materialize(after, "links")
        before = links
        same = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        links = after
        discard(before)
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = links.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _summing(size: int):
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                part = np.frombuffer(pa.decompress(blob.as_py(), size * 4, "zstd", asbytes=True), np.float32)
                totals[key] = totals[key] + part if key in totals else part.astype(np.float64)
        keys = sorted(totals)
        blobs = [pa.compress(totals.pop(k).astype(np.float32).tobytes(), "zstd", asbytes=True) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "part"])

    return run


def packed_slices(values: np.ndarray, slices: int) -> pa.RecordBatch:
    """A table of numbers as rows (slice, part) for summed_slices."""
    blobs = [pa.compress(part.tobytes(), "zstd", asbytes=True) for part in values.astype(np.float32).reshape(slices, -1)]
    return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "part"])


def summed_slices(parts: DataFrame, slices: int, size: int) -> np.ndarray:
    """The sum of the partitions' tables ``parts(slice, part)``, as (slices, size) numbers.

    Slices are added up as they stream by, first in 32 shares of the partitions, then all; the driver gets ``slices`` rows.
    """
    kind = "slice int, part binary"
    shares = parts.withColumn("share", F.spark_partition_id() % 32).repartition("slice", "share").select("slice", "part").mapInArrow(_summing(size), kind)
    table = np.zeros((slices, size), np.float32)
    for row in shares.repartition("slice").mapInArrow(_summing(size), kind).collect():
        table[row["slice"]] = np.frombuffer(pa.decompress(bytes(row["part"]), size * 4, "zstd", asbytes=True), np.float32)
    return table


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of their key alone: all if they are few, else a share that fits.

    A filter by the share, so tasks hand on what belongs to the sample and no more.
    """
    n = rows.count()
    share = min(1.0, 0.95 * most / max(1, n))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most)
