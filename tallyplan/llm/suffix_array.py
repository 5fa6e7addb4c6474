"""Suffix-array dedup of bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Each pack of contexts gets a Burrows-Wheeler transform of its texts. Starting from the intervals of single symbols, all
intervals are extended backward by one symbol at a time, breadth first; a boundary that appears with strings of length l
is a common prefix of length l - 1. The expansion stops at the minimum length: rows still in one interval share it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C
from tallyplan.llm import passages as P

MIN_BYTES = 50
#: Bytes of context in one transform: its sorts and gathers then stay near the processor.
PACK_BYTES = 1 << 18


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in the order of their first 64 symbols, by doubling from eight; a symbol of 0 closes each context. Suffixes
    that agree so far stand in any order: classes of up to 63 symbols don't depend on it."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = text
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : n + k]
    for step in (8, 16, 32):
        order = np.argsort(key)
        ordered = key[order]
        new = np.zeros(n, dtype=np.uint32)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, dtype=np.uint32)
        rank[order] = np.cumsum(new, dtype=np.uint32)
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: max(0, n - step)] |= rank[step:] + np.uint64(1)
    return np.argsort(key)


def shared_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each row): rows of a class share their first ``least`` symbols.

    Backward search over all intervals at once: row k of the next level opens an interval if its symbol is new there or
    if the row that its suffix leads to (the LF step read backward, from the transform alone) is in another interval
    than that of row k - 1.
    """
    order = suffix_order(text)
    transform = text[order - 1]
    lead = np.argsort(transform, kind="stable").astype(np.int32)  # the row that holds the suffix after that of row k
    first = transform[lead]
    opens = np.ones(len(text), dtype=bool)
    opens[1:] = first[1:] != first[:-1]
    symbol = opens.copy()
    for _ in range(1, least):
        inside = np.cumsum(opens, dtype=np.int32)[lead]
        grown = symbol.copy()
        grown[1:] |= inside[1:] != inside[:-1]
        if grown.all():
            opens = grown
            break
        opens = grown
    return order, np.cumsum(opens) - 1


def judge(group: P.Group) -> np.ndarray:
    """For each window of each entry: does a smaller doc_id have it?"""
    context, unit = group.window_places()
    # the contexts one after the other, each closed by a symbol of 0
    lengths = np.diff(group.offsets)
    text = np.zeros(len(group.text) + len(lengths), dtype=np.uint8)
    base = group.offsets[:-1] + np.arange(len(lengths))
    text[C.ragged(base, lengths)] = group.text
    order, classes = shared_prefixes(text, MIN_BYTES)
    of = np.empty(len(text), dtype=np.int64)
    of[order] = classes
    mine = of[unit + context]
    least = np.full(int(classes[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, mine, group.least[context])
    starts = np.cumsum(group.windows) - group.windows
    window = C.ragged(starts[group.distinct], group.count)
    own = np.repeat(group.docs, group.count)
    return (least[mine][window] < own) & (own != P._NONE)


def _finish(ids, buf, offsets, units, gone) -> pa.RecordBatch:
    edges = np.zeros(len(gone), dtype=bool)
    if len(gone):
        edges[0] = gone[0]
        edges[1:] = gone[1:] & ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < len(gone)]
        edges[heads] = gone[heads]
    kept, at = buf[~gone], np.concatenate([[0], np.cumsum(~gone)])[offsets]
    shas = [hashlib.sha256(kept[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    columns = [pa.array(ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(C.per_document(gone, offsets)), pa.array(C.per_document(edges, offsets)), pa.array(shas, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _finish_text(ids, buf, offsets, units, gone) -> pa.RecordBatch:
    kept, at = buf[~gone], np.concatenate([[0], np.cumsum(~gone)])[offsets]
    texts = [kept[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "kept"])


def _removed(docs: DataFrame, finish, schema: str) -> DataFrame:
    return P.remove(docs, "suffix-array", P.Bytes, judge, finish, schema, across=True, pack_bytes=PACK_BYTES)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the bytes that stay of every row of ``docs(doc_id, text, ...)``.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. A null text is
    empty; rows with one doc_id are one another's equals and remove nothing of each other; a null doc_id stays null, is
    never smaller than another and removes nothing; an empty table gives no rows; further columns are not used.
    """
    return _removed(docs, _finish_text, "doc_id long, kept binary")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text")
    return _removed(docs, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_sha256"))
