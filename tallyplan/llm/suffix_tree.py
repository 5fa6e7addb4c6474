"""Substring dedup of words: prefix-partitioned suffix trees.

The suffixes of a pack of contexts are split by prefixes of as many words as it takes until each part fits a memory
bound. A part's subtree is built from its sorted suffixes and their common prefixes. A leaf weighs as many places as its
suffix has; a node as deep as the window length that weighs two or more is a repeat, and every window below it goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyplan.llm import common as C
from tallyplan.llm import passages as P

MIN_WORDS = 35
#: Suffixes of one subtree, and bytes of context in a pack.
PART_SUFFIXES, PACK_BYTES = 1 << 14, 6 << 20


def prefix_parts(ranks: np.ndarray, suffixes: np.ndarray, most: int, depth: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """The suffixes in parts of at most ``most``, with the length of the prefix that each part's suffixes share; and those
    that are leaves, having a prefix for themselves.

    Prefixes grow by a word where a part is too large; at full depth all of a part is one repeat. Small neighbours are
    put together, with a shared length of 0.
    """
    done: list[tuple[np.ndarray, int]] = []
    leaves: list[np.ndarray] = []
    loose: list[np.ndarray] = []
    size = 0
    open_ = [(suffixes, 0)]
    while open_:
        part, shared = open_.pop()
        if len(part) <= most or shared >= depth:
            if shared >= depth or 4 * len(part) > most:
                done.append((part, shared))
            else:
                if size + len(part) > most and loose:
                    done.append((np.concatenate(loose), 0))
                    loose, size = [], 0
                loose.append(part)
                size += len(part)
            continue
        word = ranks[part + shared]
        order = np.argsort(word, kind="stable")
        word = word[order]
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        counts = np.diff(np.concatenate([cut, [len(word)]]))
        single = np.repeat(counts == 1, counts)
        small = part[order][~single & np.repeat(counts <= most // 4, counts)]
        leaves.append(part[order][single])
        # prefixes of few suffixes are cut into ranges of whole prefixes
        if len(small):
            keep = counts[(counts > 1) & (counts <= most // 4)]
            ends = np.cumsum(keep)
            at = 0
            while at < len(small):
                to = int(ends[max(0, np.searchsorted(ends, at + most, side="right") - 1)])
                to = to if to > at else int(ends[np.searchsorted(ends, at, side="right")])
                done.append((small[at:to], 0))
                at = to
        for s in np.flatnonzero(counts > most // 4):
            open_.append((part[order][cut[s] : cut[s] + counts[s]], shared + 1))
    if loose:
        done.append((np.concatenate(loose), 0))
    return done, np.concatenate(leaves) if leaves else suffixes[:0]


def deep_nodes(ranks: np.ndarray, part: np.ndarray, shared: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, node of each): the topmost internal nodes of the part's subtree that are ``depth`` deep or
    deeper, as intervals of its leaves; a leaf under none has a number of its own."""
    if shared >= depth:
        return part, np.zeros(len(part), dtype=np.int64)
    rest = ranks[part[:, None] + np.arange(shared, depth)[None, :]]
    labels = np.ascontiguousarray(rest.astype(">u4")).view(f"S{4 * rest.shape[1]}").ravel()
    order = np.argsort(labels)
    rest = rest[order]
    prefix = (rest[1:] == rest[:-1]).cumprod(axis=1).sum(axis=1) + shared  # common prefixes of neighbouring leaves
    top = np.concatenate([[0], np.cumsum(prefix < depth)])
    return part[order], top


def judge(group: P.Group) -> np.ndarray:
    """For each window of each entry: does its word sequence start anywhere else?"""
    context, unit = group.window_places()
    ranks = group.units.ranks()
    weight = np.zeros(len(ranks), dtype=np.int64)
    weight[unit] = group.weight[context]
    gone = np.zeros(len(ranks), dtype=bool)
    parts, leaves = prefix_parts(ranks, unit, PART_SUFFIXES, MIN_WORDS)
    gone[leaves] = weight[leaves] > 1
    for part, shared in parts:
        suffixes, node = deep_nodes(ranks, part, shared, MIN_WORDS)
        gone[suffixes] = np.bincount(node, weight[suffixes])[node] > 1
    places = gone[unit]
    starts = np.cumsum(group.windows) - group.windows
    return places[C.ragged(starts[group.distinct], group.count)]


def _kept_words(buf, offsets, units, gone) -> list[bytes]:
    """Each document's words that stay, joined by one space."""
    starts, ends = units.starts[~gone], units.ends[~gone]
    size = ends - starts + 1
    text = buf[np.minimum(C.ragged(starts, size), max(0, len(buf) - 1))] if len(starts) else np.zeros(0, np.uint8)
    if len(starts):
        text[np.cumsum(size) - 1] = 32
    at = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
    return [text[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _finish(ids, buf, offsets, units, gone) -> pa.RecordBatch:
    shas = [hashlib.sha256(t).hexdigest() for t in _kept_words(buf, offsets, units, gone)]
    columns = [pa.array(ids, pa.int64()), pa.array(np.diff(units.offsets)), pa.array(C.per_document(gone, units.offsets)), pa.array(shas, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _finish_text(ids, buf, offsets, units, gone) -> pa.RecordBatch:
    texts = [t.decode() for t in _kept_words(buf, offsets, units, gone)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def _removed(docs: DataFrame, finish, schema: str) -> DataFrame:
    return P.remove(docs, "suffix-tree", P.Words, judge, finish, schema, across=False, pack_bytes=PACK_BYTES)


def dedup_words(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row of ``docs(doc_id, text, ...)`` without the words of repeated 35-word windows.

    All places of a repeated window lose their words, the first included; repeated rows are places each, so such rows of
    35 words or more lose all. A null or empty text has no words; a null doc_id stays null; an empty table gives no
    rows; further columns are not used.
    """
    return _removed(docs, _finish_text, "doc_id long, text string")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(C.documents(spark, sf_dir, "doc_id", "text"), _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
