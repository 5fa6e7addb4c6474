"""Quality rules: exact document statistics, and boosted trees over them with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C
from tallyplan.llm import trees

#: Most labels that the trees are fitted on, chosen by the hashes of their ids.
SAMPLE_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols_per_char", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "long_word_share", "line_words", "pipe_share")
#: More of these never raises a document's score.
MONOTONE = {"symbols_per_char": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1}

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SYMBOL, _PIPE = _table(SYMBOLS), _table(b"|")
_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_MARK = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


def _classes(keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As exact_classes, but within documents; keys hold the document by a salt, so that they hardly ever meet across two."""
    first, inverse = C.exact_classes(keys, data, starts, sizes)
    if (doc[first][inverse] != doc).any():
        _, first, inverse = np.unique(doc * len(first) + inverse, return_index=True, return_inverse=True)
    return first, inverse


def statistics(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the documents in a block, a row each."""
    docs = len(offsets) - 1
    starts, ends = C.word_bounds(buf, offsets)
    word_doc = C.owner(starts, offsets)
    n_words = np.bincount(word_doc, minlength=docs)
    word_at = np.concatenate([[0], np.cumsum(n_words)])
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    word_chars = np.bincount(word_doc, chars, docs).astype(np.int64)
    n_symbols = C.per_document(_SYMBOL[buf], offsets)
    sums = C.byte_sums(buf)

    breaks = np.flatnonzero(buf == 10)
    line_starts = np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1])
    line_starts = np.unique(line_starts[line_starts < len(buf)])
    closing = np.append(breaks, len(buf))
    line_ends = np.minimum(closing[np.searchsorted(breaks, line_starts, side="left")], offsets[C.owner(line_starts, offsets) + 1])
    first_word = np.searchsorted(starts, line_starts)
    lined = (np.searchsorted(starts, line_ends) > first_word)
    line_starts, line_ends = line_starts[lined], line_ends[lined]
    line_doc = C.owner(line_starts, offsets)
    salt = C.mixed(np.arange(docs, dtype=np.uint64) + np.uint64(77))
    keys = C.range_hash(sums, line_starts, line_ends) ^ salt[line_doc]
    firsts, _ = _classes(keys, buf, line_starts, line_ends - line_starts, line_doc)
    n_lines = np.bincount(line_doc, minlength=docs)
    n_dup = n_lines - np.bincount(line_doc[firsts], minlength=docs)

    distinct_words, words = C.exact_classes(C.range_hash(sums, starts, ends), buf, starts, ends - starts)
    n_repeat = np.zeros(docs, dtype=np.int64)
    if len(words) >= 8:
        at = np.arange(len(words) - 7)
        at = at[word_doc[at] == word_doc[at + 7]]
        windows = C.range_hash(C.prefix_sums(C.mixed(words.astype(np.uint64) + np.uint64(1))), at, at + 8) ^ salt[word_doc[at]]
        _, inverse = _classes(windows, words, at, np.full(len(at), 8), word_doc[at])
        hit = at[np.bincount(inverse)[inverse] > 1]
        marks = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + 8, -1)
        n_repeat = C.per_document(np.cumsum(marks[:-1]) > 0, word_at)
    _, firsts = np.unique(word_doc * len(distinct_words) + words, return_index=True)
    distinct = np.bincount(word_doc[firsts], minlength=docs)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1).astype(np.int64)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack([
        np.log1p(n_words), word_chars / w, n_symbols / c, n_dup / np.maximum(n_lines, 1), n_repeat / w,
        C.per_document(_UPPER[buf], offsets) / c, C.per_document(_DIGIT[buf], offsets) / c, C.per_document(_MARK[buf], offsets) / c,
        distinct / w, np.bincount(word_doc, chars > 12, docs) / w, n_words / np.maximum(n_lines, 1), C.per_document(_PIPE[buf], offsets) / c,
    ], axis=1)
    return counts, features


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, rows, buf, offsets in C.text_blocks(batch):
            counts, features = statistics(buf, offsets)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, rows), *(pa.array(counts[:, k]) for k in range(counts.shape[1])), *(pa.array(features[:, k]) for k in range(features.shape[1]))],
                ["doc_id", *COUNTS, *FEATURES],
            )


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, the exact counts and the features of every whole text. A null or empty text counts as no words."""
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_profile, schema)


def train(profiles: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> trees.Forest:
    """Fits on at most ``sample_rows`` labels, whose 16 bytes each are all that is broadcast, and the rows of their ids (twice
    as many at most). Without labels of both kinds the forest is its base rate."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = profiles.join(F.broadcast(C.hash_sample(marks, "doc_id", sample_rows)), "doc_id").limit(2 * sample_rows).select("doc_id", "quality", *FEATURES).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES])
    monotone = {FEATURES.index(k): v for k, v in MONOTONE.items()}
    return trees.fit(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float), monotone)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base rules and the forest's verdict for every row of ``docs(doc_id, text, ...)``.

    Repeated rows are judged each; a null or empty text fails the base rules (fewer than 20 words); a null doc_id
    stays null and is judged by its text; an empty table gives no rows; further columns are not used.
    """
    profiles = C.materialize(profile(docs), "profile")
    forest = train(profiles, labels, sample_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(f)) for f in FEATURES], axis=1) if batch.num_rows else np.zeros((0, len(FEATURES)))
            score = forest.scores(x)
            words, repeat = np.asarray(batch.column("n_words")), np.asarray(batch.column("n_repeat_words"))
            failed = (words < 20) | (100 * repeat > 30 * words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in COUNTS), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                ["doc_id", *COUNTS, "base_failed", "kept", "score"],
            )

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, score double"])
    return profiles.mapInArrow(judge, schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_rules(C.documents(spark, sf_dir, "doc_id", "text"), labels)
