"""Shared plan of the two exact passage operators: chunks, anchors, contexts, and the removal of what repeats.

A window is a run of a fixed number of units (words or bytes) of one document. Its anchor is its gram of least hash, so
equal windows have equal anchors at equal places. Only anchors that stand in two places can hold a repeated window;
their contexts (all windows of one anchor place, with the text they span) are dealt out by anchor, each bucket is judged
by an operator's own index, and the verdicts return to the chunks, where they hold for all copies of a context. All steps
are exact: hashes say which texts may be equal, and the texts are then compared; an anchor's key is cut to 48 bits, which can
only bring contexts together that turn out to differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyplan.llm import common as C

#: Anchors of a bucket, bytes of text for a bucket of contexts, and what a task holds before it hands on.
BUCKET_ANCHORS, BUCKET_TEXT = 600_000, 6 << 20
FLUSH_ANCHORS, FLUSH_BYTES = 3_000_000, 24 << 20
#: Bytes of text in a chunk.
CHUNK_BYTES = 2 << 20
#: Chunks that may share an anchor. The contexts of a more frequent one are divided into their windows, which are dealt out by
#: their own content, so that no bucket grows with the places of an anchor.
HOT_CHUNKS = 1 << 16
#: Chunks are written once and read three times, so they are worth a higher level of compression.
CHUNK_LEVEL = 5
_U = np.uint64
_PLACE_BITS = 24
_NONE = np.iinfo(np.int64).max  # stands for a null doc_id: never smaller than another


def deflate(raw: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; high bytes that hardly vary cost next to nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return deflate(np.ascontiguousarray(planes).tobytes())


def expand(blob: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(blob, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


class Words:
    """Units are the words ``[^\\x20\\x09-\\x0D]+``."""

    window, gram = 35, 8

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends = C.word_bounds(buf, offsets)
        self.values = C.range_hash(C.byte_sums(buf), self.starts, self.ends)
        self.offsets = np.searchsorted(self.starts, offsets)
        # the words alone, each with one space after it
        self.sizes = self.ends - self.starts
        self.text = buf[np.minimum(C.ragged(self.starts, self.sizes + 1), max(0, len(buf) - 1))]
        self.at = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.text[self.at[1:] - 1] = 32

    def slices(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges in ``text`` of the units first to last (exclusive)."""
        return self.at[first], self.at[last] - 1

    def ranks(self) -> np.ndarray:
        """A number for each unit, from 1; equal units have equal numbers."""
        return C.exact_classes(self.values, self.text, self.at[:-1], self.sizes)[1] + 1


class Bytes:
    """Units are the bytes themselves."""

    window, gram = 50, 24

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.values = C._BYTE_KEYS[buf]
        self.offsets = offsets
        self.text = buf

    def slices(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first, last


class Runs:
    """The runs of windows of a chunk that share an anchor place: key, first and number of windows, document."""

    def __init__(self, units):
        window, gram = units.window, units.gram
        n, width = len(units.values), units.window - units.gram + 1
        sums = C.prefix_sums(units.values)
        self.sums = sums
        keys, firsts, counts = [], [], []
        step = 1 << 22
        for a in range(0, max(0, n - window + 1), step):
            b = min(n - window + 1, a + step)  # windows a to b
            at = np.arange(a, b + width - 1)
            h = C.range_hash(sums, at, at + gram)
            v = (h & ~_U((1 << _PLACE_BITS) - 1)) | np.arange(len(at), dtype=np.uint64)
            m, have = v, 1
            while have < width:
                more = min(have, width - have)
                m = np.minimum(m[: len(m) - more], m[more:])
                have += more
            place = (m[: b - a] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
            doc = C.owner(np.arange(a, b), units.offsets) if len(units.offsets) < 3 else np.repeat(np.arange(len(units.offsets) - 1), np.diff(units.offsets))[a:b]
            whole = np.arange(a, b) + window <= units.offsets[doc + 1]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            p = place[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
            cut = np.flatnonzero(new)
            keys.append(h[p[cut]] >> _U(16)), firsts.append(at[cut] + a), counts.append(np.diff(np.concatenate([cut, [len(at)]])))
        self.key, self.first, self.count = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((keys, np.uint64), (firsts, np.int64), (counts, np.int64)))
        self.doc = C.owner(self.first, units.offsets)
        self.last = self.first + self.count - 1 + window  # unit after the context

    def contexts(self, units, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of equal contexts: the first run of each and each run's class, and whether a run's document is its
        class's least. The first run is one of the least document."""
        a, b = units.slices(self.first, self.last)
        order = np.argsort(docs, kind="stable")
        first, inverse = C.exact_classes(C.range_hash(self.sums, self.first[order], self.last[order]), units.text, a[order], (b - a)[order])
        of = np.empty(len(order), dtype=np.int64)
        of[order] = inverse
        first = order[first]
        return first, of, docs == docs[first][of]


def chunks_of(docs: DataFrame, tag: str, chunk_bytes: int) -> DataFrame:
    """Texts in compressed chunks of about ``chunk_bytes``, written to the shared folder: (chunk, size, ids, lengths, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
        for batch in batches:
            for first, rows, buf, offsets in C.text_blocks(batch, limit=chunk_bytes):
                data = deflate(buf.tobytes(), CHUNK_LEVEL)
                yield pa.RecordBatch.from_arrays([pa.array([len(buf)], pa.int64()), pa.array([batch.column(0).slice(first, rows).to_pylist()], kind.field(1).type), pa.array([np.diff(offsets).tolist()], kind.field(2).type), pa.array([data], pa.binary())], schema=kind)

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "size long, ids array<long>, lengths array<long>, data binary")
    return C.materialize(packed.withColumn("chunk", F.monotonically_increasing_id()), tag)


def opened(size: int, lengths: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return buf, np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))])


def _ids(ids: list[int | None]) -> np.ndarray:
    return np.array([_NONE if i is None else i for i in ids], dtype=np.int64)


def _anchors(kind, buckets: int, across: bool):
    """Distinct anchor keys of each chunk, in blobs by bucket; a key's lowest bit says that the chunk alone repeats it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key = np.concatenate([k for _, k in held])
            ref = np.repeat(np.arange(len(held), dtype=np.uint32), [len(k) for _, k in held])
            bucket = (key >> _U(1)) % _U(buckets)
            order = np.lexsort((key, bucket))
            key, ref, bucket = key[order], ref[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = np.concatenate([cut[1:], [len(bucket)]])
            chunks = np.array([c for c, _ in held], dtype=np.int64)
            held.clear()
            rows = []
            for x, y in zip(cut.tolist(), ends.tolist(), strict=True):
                used, place = np.unique(ref[x:y], return_inverse=True)  # a row names only the chunks that it needs
                rows.append((int(bucket[x]), y - x, chunks[used].tolist(), squeeze(np.diff(key[x:y], prepend=_U(0))), squeeze(place.astype(np.uint32))))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], ["bucket", "n", "chunks", "keys", "refs"])

        total = 0
        for batch in batches:
            for chunk, size, ids, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "size", "ids", "lengths")), batch.column("data"), strict=True):
                runs = Runs(kind(*opened(size, lengths, data.as_py())))
                order = np.argsort(runs.key, kind="stable")
                key, owner = runs.key[order], _ids(ids)[runs.doc[order]]
                if not len(key):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                low, high = np.minimum.reduceat(owner, cut), np.maximum.reduceat(owner, cut)
                twice = low != high if across else np.diff(np.concatenate([cut, [len(key)]])) > 1
                held.append((chunk, (key[cut] << _U(1)) | twice.astype(np.uint64)))
                total += len(cut)
                if total >= FLUSH_ANCHORS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return run


def _by_key(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key, over batches in order of the key."""
    key, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(batch.column(c) for c in names), strict=True):
            row = dict(zip(names, (v.as_py() for v in values), strict=True))
            if rows and row[column] != key:
                yield key, rows
                rows = []
            key = row[column]
            rows.append(row)
    if rows:
        yield key, rows


def _repeated(hot_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _repeated_keys(batches, hot_chunks)

    return run


def _repeated_keys(batches: Iterator[pa.RecordBatch], hot_chunks: int) -> Iterator[pa.RecordBatch]:
    """For each bucket and chunk the keys that stand in two places, their lowest bit set if they stand in too many chunks."""
    for _, rows in _by_key("bucket", batches):
        keys = np.concatenate([np.cumsum(expand(r["keys"], r["n"], np.uint64)) for r in rows])
        chunk = np.concatenate([np.array(r["chunks"], dtype=np.int64)[expand(r["refs"], r["n"], np.uint32)] for r in rows])
        order = np.argsort(keys >> _U(1), kind="stable")
        keys, chunk = keys[order], chunk[order]
        bare = keys >> _U(1)
        cut = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
        size = np.diff(np.concatenate([cut, [len(bare)]]))
        flagged = np.maximum.reduceat((keys & _U(1)).astype(np.uint8), cut) > 0
        keep = np.repeat((size > 1) | flagged, size)
        bare = bare << _U(1) | np.repeat(size > hot_chunks, size).astype(np.uint64)
        bare, chunk = bare[keep], chunk[keep]
        order = np.lexsort((bare, chunk))
        bare, chunk = bare[order], chunk[order]
        cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
        ends = np.concatenate([cut[1:], [len(chunk)]]).astype(np.int64)
        for lo in range(0, len(cut), 2_000):
            part = list(zip(cut[lo : lo + 2_000], ends[lo : lo + 2_000], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(chunk[a]) for a, _ in part], pa.int64()), pa.array([int(b - a) for a, b in part], pa.int64()), pa.array([squeeze(np.diff(bare[a:b], prepend=_U(0))) for a, b in part], pa.binary())], ["chunk", "n", "blob"])


def with_chunks(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks and the notes (chunk, n, blob) on them, in order of the chunk."""
    a = chunks.select("chunk", "size", "ids", "lengths", "data", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("blob"))
    b = notes.select("chunk", *(F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("ids", "array<long>"), ("lengths", "array<long>"), ("data", "binary"))), "n", "blob")
    return a.unionByName(b).repartition("chunk").sortWithinPartitions("chunk")


def _contexts(kind, buckets: int):
    """Distinct contexts of a chunk's repeated anchors, in blobs by bucket: each by its first place in the document of the
    smallest doc_id, and with the number of its places (2 for more). The others follow its verdict in _digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["bucket", "n", "bytes", "keys", "docs", "chunks", "places", "counts", "sizes", "weights", "data"]

        def flush() -> Iterator[pa.RecordBatch]:
            key, docs, chunk, place, count, size, weight = (np.concatenate([h[k] for h in held]) for k in range(7))
            text = np.concatenate([h[7] for h in held])
            held.clear()
            at = np.concatenate([[0], np.cumsum(size)])
            bucket = (key % _U(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else np.zeros(0, np.int64)
            ends = np.concatenate([cut[1:], [len(order)]]).astype(np.int64)
            for a, b in zip(cut, ends, strict=False):
                some = order[a:b]
                data = text[C.ragged(at[some], size[some])]
                blobs = [squeeze(x[some]) for x in (key, docs, chunk, place.astype(np.uint32), count.astype(np.uint8), size.astype(np.uint32), weight.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(bucket[some[0]]), len(some), len(data))] + [pa.array([x], pa.binary()) for x in (*blobs, deflate(data.tobytes()))], names)

        total = 0
        for chunk, rows in _by_key("chunk", batches):
            head = next(r for r in rows if r["data"] is not None)
            wanted = [np.cumsum(expand(r["blob"], r["n"], np.uint64)) for r in rows if r["blob"] is not None]
            if not wanted:
                continue
            wanted = np.unique(np.concatenate(wanted))
            wanted, hot = wanted >> _U(1), wanted & _U(1) > 0
            buf, offsets = opened(head["size"], head["lengths"], head["data"])
            units = kind(buf, offsets)
            runs = Runs(units)
            where = np.minimum(np.searchsorted(wanted, runs.key), len(wanted) - 1)
            docs = _ids(head["ids"])[runs.doc]
            some, of, _ = runs.contexts(units, docs)
            weight = np.minimum(np.bincount(of), 2)
            good = wanted[where[some]] == runs.key[some]
            some, weight = some[good], weight[good]
            divided = np.where(hot[where[some]], runs.count[some], 1)  # windows of their own
            first, count = C.ragged(runs.first[some], divided), np.repeat(np.where(divided > 1, 1, runs.count[some]), divided)
            key, last = np.repeat(runs.key[some], divided), first + count - 1 + kind.window
            alone = np.repeat(hot[where[some]], divided)
            key[alone] = C.mixed(C.range_hash(runs.sums, first[alone], last[alone])) >> _U(16)
            a, b = units.slices(first, last)
            text = units.text[C.ragged(a, b - a)]
            held.append((key, np.repeat(docs[some], divided), np.full(len(first), chunk, np.int64), first, count, b - a, np.repeat(weight, divided), text))
            total += len(text) + 40 * len(first)
            if total >= FLUSH_BYTES:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    return run


class Group:
    """The contexts of some anchors: distinct texts, and each entry's text, document, chunk, place, windows and weight."""

    def __init__(self, kind, key, docs, chunk, place, count, size, weight, text):
        self.docs, self.chunk, self.place, self.count = docs, chunk, place, count
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        hashes = C.range_hash(C.byte_sums(text), at[:-1], at[1:])
        first, self.distinct = C.exact_classes(hashes, text, at[:-1], size)
        # the distinct contexts' own units, one after the other
        self.text = text[C.ragged(at[:-1][first], size[first])]
        self.units = kind(self.text, np.concatenate([[0], np.cumsum(size[first])]))
        self.offsets = self.units.offsets
        self.windows = count[first]
        self.weight = np.bincount(self.distinct, weight).astype(np.int64)
        self.least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.distinct, docs)

    def window_places(self) -> tuple[np.ndarray, np.ndarray]:
        """(context, unit) of every window of the distinct contexts."""
        return np.repeat(np.arange(len(self.windows)), self.windows), C.ragged(self.offsets[:-1], self.windows)


def _judge(kind, judge: Callable[[Group], np.ndarray], pack_bytes: int):
    """Intervals of windows (chunk, first, last unit) that ``judge`` finds repeated, by bucket.

    A bucket's anchors are taken in packs of about ``pack_bytes`` of context, which bounds the index's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key("bucket", batches):
            kinds = (("keys", np.uint64), ("docs", np.int64), ("chunks", np.int64), ("places", np.uint32), ("counts", np.uint8), ("sizes", np.uint32), ("weights", np.uint8))
            key, docs, chunk, place, count, size, weight = (np.concatenate([expand(r[c], r["n"], t) for r in rows]) for c, t in kinds)
            place, count, size = place.astype(np.int64), count.astype(np.int64), size.astype(np.int64)
            text = np.concatenate([np.frombuffer(pa.decompress(r["data"], r["bytes"], "zstd", asbytes=True), np.uint8) for r in rows])
            at = np.concatenate([[0], np.cumsum(size)])
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            cut = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
            pack = np.cumsum(np.add.reduceat(size[order], cut)) // pack_bytes
            packs = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]]))
            bounds = np.concatenate([cut[packs], [len(order)]])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                some = order[a:b]
                group = Group(kind, key[some], docs[some], chunk[some], place[some], count[some], size[some], weight[some], text[C.ragged(at[some], size[some])])
                gone = judge(group)  # a flag for each window of each entry
                found.append((np.repeat(group.chunk, group.count)[gone], C.ragged(group.place, group.count)[gone]))
            owner, first = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(first):
                continue
            # one row for each chunk: the runs of windows that go
            turn = np.lexsort((first, owner))
            first, owner = first[turn], owner[turn]
            begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[1:] > first[:-1] + 1)]))
            finish = np.concatenate([begin[1:], [len(first)]]) - 1
            lo, hi, own = first[begin], first[finish] + kind.window, owner[begin]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ends = np.concatenate([edge[1:], [len(own)]])
            for k in range(0, len(edge), 2_000):
                part = list(zip(edge[k : k + 2_000].tolist(), ends[k : k + 2_000].tolist(), strict=True))
                blobs = [squeeze(np.concatenate([lo[x:y], hi[x:y]]).astype(np.uint32)) for x, y in part]
                yield pa.RecordBatch.from_arrays([pa.array([int(own[x]) for x, _ in part], pa.int64()), pa.array([y - x for x, y in part], pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "n", "blob"])

    return run


def _digest(kind, across: bool, finish: Callable):
    """Applies the intervals, to a context's copies in the chunk as well, and lets ``finish`` make the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key("chunk", batches):
            head = next(r for r in rows if r["data"] is not None)
            buf, offsets = opened(head["size"], head["lengths"], head["data"])
            units = kind(buf, offsets)
            runs = Runs(units)
            n, window = len(units.values), kind.window
            marks = np.zeros(n + 2, dtype=np.int64)
            for r in rows:
                if r["blob"] is not None:
                    span = expand(r["blob"], 2 * r["n"], np.uint32).astype(np.int64)
                    np.add.at(marks, span[: r["n"]], 1)
                    np.add.at(marks, span[r["n"] :] - window + 1, -1)
            gone = np.cumsum(marks[:n]) > 0  # windows, by their first unit
            if len(runs.first):
                docs = _ids(head["ids"])[runs.doc]
                first, of, least = runs.contexts(units, docs)
                copies = np.flatnonzero(first[of] != np.arange(len(of)))
                if across:
                    other = copies[~least[copies] & (docs[copies] != _NONE)]
                    gone[C.ragged(runs.first[other], runs.count[other])] = True
                    copies = copies[least[copies]]
                like = first[of[copies]]
                gone[C.ragged(runs.first[copies], runs.count[copies])] = gone[C.ragged(runs.first[like], runs.count[copies])]
            begin = np.flatnonzero(gone)
            marks = np.zeros(n + 1, dtype=np.int64)
            marks[begin] += 1
            np.add.at(marks, begin + window, -1)
            yield finish(head["ids"], buf, offsets, units, np.cumsum(marks[:n]) > 0)

    return run


def remove(docs: DataFrame, tag: str, kind, judge: Callable[[Group], np.ndarray], finish: Callable, schema: str, across: bool, pack_bytes: int, chunk_bytes: int = CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """The whole plan. ``across``: only windows of documents with a smaller doc_id count, instead of any other place."""
    chunks = chunks_of(docs, f"{tag}-chunks", chunk_bytes)
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_unit = 6 if kind is Words else 1
    buckets = 1 + int(total / per_unit * 2 / (kind.window - kind.gram + 2) / BUCKET_ANCHORS)
    anchors = chunks.mapInArrow(_anchors(kind, buckets, across), "bucket long, n long, chunks array<long>, keys binary, refs binary")
    repeated = anchors.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(hot_chunks), "chunk long, n long, blob binary")
    buckets = 1 + int(total / BUCKET_TEXT)
    contexts = with_chunks(chunks, repeated).mapInArrow(_contexts(kind, buckets), "bucket long, n long, bytes long, keys binary, docs binary, chunks binary, places binary, counts binary, sizes binary, weights binary, data binary")
    gone = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge(kind, judge, pack_bytes), "chunk long, n long, blob binary")
    return with_chunks(chunks, gone).mapInArrow(_digest(kind, across, finish), schema)
