"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C

#: Most labelled rows that the network is fitted on, chosen by the hashes of their ids.
SAMPLE_ROWS = 20_000
#: Buckets of the word table, and the vectors' length: the table's size is their product, whatever the corpus.
BUCKETS, DIMS = 1 << 14, 32
#: Neighbours on either side that a word's vector gathers.
REACH = 2
#: Rows of the word table that travel together when the partitions' tables are added up.
SLICES = 16

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
#: The class of letters of scripts that set no spaces between words, and of marks beyond ASCII.
_UNSPACED, _MARK = 4, 3
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_FOLD = C._BYTE_KEYS.copy()
_FOLD[65:91] = _FOLD[97:123]


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; those of a character beyond ASCII have one class."""
    kind = _CLASS[buf]
    if not (buf >= 0xE0).any():
        return kind
    at = np.flatnonzero(buf >= 0xE0)
    b0, b1 = buf[at].astype(np.int64), buf[np.minimum(at + 1, len(buf) - 1)].astype(np.int64)
    b2 = buf[np.minimum(at + 2, len(buf) - 1)].astype(np.int64)
    point = (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63
    wide = b0 >= 0xF0
    # Unicode blocks. Thai to Tibetan, Burmese, Khmer, CJK with kana, half-width kana; marks and full-width marks.
    unspaced = (0xE00 <= point) & (point < 0x1000) | (0x1000 <= point) & (point < 0x10A0) | (0x1780 <= point) & (point < 0x1800) | (0x2E80 <= point) & (point < 0xA000)
    unspaced |= (0xF900 <= point) & (point < 0xFB00) | (0xFF66 <= point) & (point < 0xFFA0)
    mark = (0x2000 <= point) & (point < 0x2E00) | (0x3000 <= point) & (point < 0x3005) | (0x3008 <= point) & (point < 0x3021) | (0xFF00 <= point) & (point < 0xFF10)
    unspaced = np.where(wide, (b1 >= 0xA0) & (b0 == 0xF0), unspaced & ~mark)  # the planes of further ideographs
    value = np.where(unspaced, _UNSPACED, np.where(mark & ~wide, _MARK, kind[at])).astype(np.uint8)
    for k in range(4):
        here = (at + k < len(buf)) & ((k < 3) | wide)
        kind[at[here] + k] = value[here]
    return kind


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Sparse ternary index vectors: for each bucket the places of its +1 and its -1."""
    rng = np.random.default_rng(811)
    plus = rng.integers(0, dims, buckets)
    return np.stack([plus, (plus + rng.integers(1, dims, buckets)) % dims], axis=1)


def tokens(buf: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the tokens, in order: runs of letters, of digits or of other marks.

    Every token stands for all of its bytes. Words of more than six characters are followed by their case and last three
    characters as a token of its own, so that words never seen before share a vector with like ones. A run of a script
    without spaces gives its characters one by one and in pairs.
    """
    kind = classes(buf)
    starts, ends = _class_bounds(kind, offsets)
    sums = C.byte_sums(buf, _FOLD)
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    head = (buf & 0xC0) != 0x80  # the first byte of a character
    heads = np.flatnonzero(head)
    before = np.concatenate([[0], np.cumsum(head)])
    length = before[ends] - before[starts]
    unspaced = kind[starts] == _UNSPACED
    word = ~unspaced
    caps = (upper[ends] - upper[starts] >= 2).astype(np.uint64) * np.uint64(2)
    long = word & (length > 6)
    from_, to, shape = [starts[word], heads[before[ends[long]] - 3]], [ends[word], ends[long]], [caps[word], caps[long] + np.uint64(1)]
    if unspaced.any():
        first, n = before[starts[unspaced]], length[unspaced]
        after = np.append(heads, len(buf))
        for size in (1, 2):
            at = C.ragged(first, np.maximum(n - size + 1, 0))
            from_.append(after[at]), to.append(np.minimum(after[at + size], np.repeat(ends[unspaced], np.maximum(n - size + 1, 0)))), shape.append(np.full(len(at), size + 3, np.uint64))
    place, last, shape = np.concatenate(from_), np.concatenate(to), np.concatenate(shape)
    order = np.lexsort((place, last)) if len(from_) > 2 or long.any() else slice(None)
    place, last, shape = place[order], last[order], shape[order]
    h = C.mixed(C.range_hash(sums, place, last) + shape * np.uint64(0x9E3779B97F4A7C15))
    return (h % np.uint64(buckets)).astype(np.int64), C.owner(place, offsets)


def _class_bounds(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    real = kind[at[:-1]] > 0
    return at[:-1][real], at[1:][real]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    total, seen = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS)
    for batch in batches:
        for _, _, buf, offsets in C.text_blocks(batch):
            ids, doc = tokens(buf, offsets)
            if not len(ids):
                continue
            seen += np.bincount(ids, minlength=BUCKETS)
            for step in range(1, REACH + 1):
                same = doc[step:] == doc[:-step]
                a, b = ids[step:][same], ids[:-step][same]
                for word, near in ((a, b), (b, a)):
                    total += np.bincount(word * DIMS + index[near, 0], minlength=BUCKETS * DIMS)
                    total -= np.bincount(word * DIMS + index[near, 1], minlength=BUCKETS * DIMS)
    yield C.packed_slices(np.concatenate([total.reshape(BUCKETS, DIMS), seen[:, None]], axis=1), SLICES)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The bounded table of word vectors, gathered from every text: unit rows, weighted down for frequent words."""
    parts = docs.select("text").mapInArrow(_gather, "slice int, part binary")
    table = C.summed_slices(parts, SLICES, BUCKETS // SLICES * (DIMS + 1)).reshape(BUCKETS, DIMS + 1)
    vectors, seen = table[:, :-1], table[:, -1]
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = seen / max(1.0, float(seen.sum()))
    return (vectors * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pooled(buf: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each document, and the logarithm of its tokens; zeros if it has none."""
    docs = len(offsets) - 1
    ids, doc = tokens(buf, offsets)
    count = np.bincount(doc, minlength=docs)
    mean, square = np.zeros((docs, vectors.shape[1])), np.zeros((docs, vectors.shape[1]))
    full = np.flatnonzero(count)
    if len(full):
        firsts = np.cumsum(count) - count
        for d0 in range(0, len(full), 256):  # bounds the gathered rows
            some = full[d0 : d0 + 256]
            a, b = firsts[some[0]], firsts[some[-1]] + count[some[-1]]
            for lo in range(a, b, 1 << 18):
                hi = min(b, lo + (1 << 18))
                part = vectors[ids[lo:hi]]
                inside = some[(firsts[some] + count[some] > lo) & (firsts[some] < hi)]
                cuts = np.maximum(firsts[inside], lo) - lo
                mean[inside] += np.add.reduceat(part, cuts, axis=0)
                square[inside] += np.add.reduceat(part * part, cuts, axis=0)
    n = np.maximum(count, 1)[:, None]
    mean /= n
    deviation = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return np.concatenate([mean, deviation, np.log1p(count)[:, None]], axis=1).astype(np.float32)


def _pool(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, rows, buf, offsets in C.text_blocks(batch):
                x = pooled(buf, offsets, vectors)
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "pooled"])

    return run


class Network:
    """Two layers over standardised inputs; probabilities are those of the logit over a temperature."""

    def __init__(self, inputs: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), 0.0
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4) -> Network:
        """Adam on four fifths of the rows; the temperature is the one that suits the last fifth best."""
        if not len(y) or not 0 < y.sum() < len(y):
            share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
            self.w2[:], self.b2 = 0, float(np.log(share / (1 - share)))
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        zt, yt = z[~held], y[~held]
        weight = np.where(yt == 1, 0.5 / max(yt.mean(), 1e-6), 0.5 / max(1 - yt.mean(), 1e-6)) ** 0.5
        rng, step = np.random.default_rng(3), 0
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for at in range(0, len(yt), 128):
                rows = order[at : at + 128]
                a = np.tanh(zt[rows] @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -40, 40)))
                e = (p - yt[rows]) * weight[rows] / len(rows)
                back = np.outer(e, params[2]) * (1 - a * a)
                grads = [zt[rows].T @ back + decay * params[0], back.sum(0), a.T @ e + decay * params[2], np.array([e.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])
        if held.any():
            logit, target = self.logits(x[held]), y[held]
            losses = {t: float(np.mean(np.logaddexp(0, -logit / t * (2 * target - 1)))) for t in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(losses, key=losses.get))
        return self


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1, at most ``sample_rows`` of them.

    The sample's ids (16 bytes each) are all that is broadcast.
    """
    marks = labels.where("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = C.hash_sample(marks, "doc_id", sample_rows)
    pools = docs.join(F.broadcast(sample.select("doc_id")), "doc_id").mapInArrow(_pool(vectors), "doc_id long, pooled binary")
    rows = pools.groupBy("doc_id").agg(F.min("pooled").alias("pooled")).join(F.broadcast(sample), "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["pooled"], np.float32) for r in rows]).astype(float) if rows else np.zeros((0, 2 * DIMS + 1))
    return Network(2 * DIMS + 1).fit(x, np.array([float(r["quality"]) for r in rows]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """The word vectors gather from all texts; the network is fitted on a bounded sample of labelled rows."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    vectors = word_vectors(docs)
    return vectors, train(docs, labels, vectors, sample_rows)


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs(doc_id, text, ...)``.

    A null or empty text is scored as a document without words; a null doc_id stays null and counts as not held out;
    repeated rows are scored alike; an empty table gives no rows; further columns are not used.
    """
    vectors, network = fit(docs, labels, sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, buf, offsets in C.text_blocks(batch):
                s = pa.array(network.scores(pooled(buf, offsets, vectors).astype(float)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), s, pc.cast(pc.greater_equal(s, 0.5), pa.int32())], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(C.documents(spark, sf_dir, "doc_id", "text"), labels)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the classifier rejects go; the others pass with all their columns, without a shuffle."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    vectors, network = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, buf, offsets in C.text_blocks(batch):
                good = network.scores(pooled(buf, offsets, vectors).astype(float)) >= 0.5
                yield batch.slice(first, rows).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
