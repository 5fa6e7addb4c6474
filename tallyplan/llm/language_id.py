"""Language identification: a linear-chain CRF labels every word; a document takes the label of most posterior mass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C

#: Most documents that the CRF's weights are fitted on, an equal share for each language, chosen by the hashes of their ids;
#: and the stretches of words taken from each, spread over its whole text.
SAMPLE_DOCS, STRETCHES = 4_000, 12
#: Buckets of the hashed weights and of the lexicon.
BUCKETS = 1 << 16
SLICES = 8
#: Most words of a training sequence; the stretches of two documents meet in each, so that transitions are learned.
STEPS = 32
#: Words handled at once by forward-backward.
GROUP_WORDS = 1 << 18

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte Latin capitals."""
    out = _FOLD[buf]
    if len(out) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        out[1:][latin] += 0x20
    return out


class Words:
    """The words of a block (runs of letters) and their features' buckets."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = folded(buf)
        self.starts, self.ends = C.run_bounds(_LETTER[buf], offsets)
        self.doc = C.owner(self.starts, offsets)
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.sums = C.byte_sums(low)
        self.low = low

    def lexicon(self, some=slice(None)) -> np.ndarray:
        return (C.range_hash(self.sums, self.starts[some], self.ends[some]) % np.uint64(BUCKETS)).astype(np.int64)

    def affixes(self, some=slice(None)) -> np.ndarray:
        """Buckets of the prefixes and suffixes of one to four bytes, a column each."""
        s, e = self.starts[some], self.ends[some]
        out = np.empty((len(s), 8), dtype=np.int64)
        for k in range(1, 5):
            for column, (a, b) in ((k - 1, (s, np.minimum(s + k, e))), (k + 3, (np.maximum(e - k, s), e))):
                h = C.range_hash(self.sums, a, b) + np.uint64((0x9E3779B97F4A7C15 * (column + 1)) & (2**64 - 1))
                out[:, column] = (C.mixed(h) % np.uint64(BUCKETS)).astype(np.int64)
        return out

    def grams(self) -> np.ndarray:
        """Buckets of the trigram that starts at every byte; those that leave their word are only read up to its end."""
        n = len(self.low)
        at = np.zeros(n, dtype=np.int64)
        if n >= 3:
            at[: n - 2] = self.low[: n - 2].astype(np.int64) * 65536 + self.low[1 : n - 1].astype(np.int64) * 256 + self.low[2:]
        return (at * 0x9E3779B1 >> 7) % BUCKETS


def emissions(words: Words, model: dict, lo: int, hi: int) -> np.ndarray:
    """Scores of the labels for words lo to hi."""
    some = slice(lo, hi)
    score = np.repeat(model["bias"][None], hi - lo, axis=0).astype(np.float32)
    buckets = words.affixes(some)
    for k in range(buckets.shape[1]):
        score += model["affix"][buckets[:, k]]
    s, e = words.starts[some], words.ends[some]
    long = np.flatnonzero(e - s >= 3)
    if len(long):
        a, b = int(s[0]), int(e[-1])
        per = model["gram"][_grams(words, a, b)]
        sums = np.zeros((len(per) + 1, per.shape[1]))
        np.cumsum(per, axis=0, out=sums[1:])
        n = (e - s - 2)[long]
        score[long] += ((sums[s[long] - a + n] - sums[s[long] - a]) / n[:, None]).astype(np.float32)
    score += model["lexicon"][words.lexicon(some)]
    return score


def _grams(words: Words, a: int, b: int) -> np.ndarray:
    low = words.low[a : min(b + 2, len(words.low))].astype(np.int64)
    low = np.concatenate([low, np.zeros(max(0, b + 2 - a - len(low)), np.int64)])
    return ((low[:-2] * 65536 + low[1:-1] * 256 + low[2:]) * 0x9E3779B1 >> 7) % BUCKETS


def marginals(scores: np.ndarray, counts: np.ndarray, stay: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posterior label probabilities of the words of sequences laid one after the other; ``stay`` holds exp(transitions).

    ``pairs`` is increased by the posterior probabilities of the labels of neighbours, summed over all of them. Scaled forward-backward over all sequences at once, step by step; sequences are in falling order of length inside.
    """
    labels = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    out = np.empty_like(emit)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    firsts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    if not len(order):
        return out
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    alpha = np.empty_like(emit)
    state = np.full((len(order), labels), 1.0 / labels)
    for t in range(lengths[0]):
        k = alive[t]
        at = firsts[:k] + t
        state = (state[:k] @ stay if t else state[:k]) * emit[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    beta = np.ones((len(order), labels))
    for t in range(lengths[0] - 1, -1, -1):
        k = alive[t]
        at = firsts[:k] + t
        post = alpha[at] * beta[:k]
        out[at] = post / post.sum(axis=1, keepdims=True)
        if pairs is not None and t:
            joint = alpha[at - 1][:, :, None] * stay[None] * (beta[:k] * emit[at])[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = (beta[:k] * emit[at]) @ stay.T
        beta[:k] = back / back.sum(axis=1, keepdims=True)
    return out


def _count_words(langs: list[str]):
    place = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS * len(langs))
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, rows, buf, offsets in C.text_blocks(batch):
                words = Words(buf, offsets)
                counts += np.bincount(words.lexicon() * len(langs) + lang[first : first + rows][words.doc], minlength=len(counts))
        yield C.packed_slices(counts, SLICES)

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of up to STEPS // 2 words, evenly spread over each whole text; all of a text that has no more."""
    half = STEPS // 2
    for batch in batches:
        ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        for first, _, buf, offsets in C.text_blocks(batch):
            starts, ends = C.run_bounds(_LETTER[buf], offsets)
            count = np.bincount(C.owner(starts, offsets), minlength=len(offsets) - 1)
            rows = []
            for d, at in zip(np.flatnonzero(count).tolist(), (np.cumsum(count) - count)[count > 0].tolist(), strict=True):
                n = int(count[d])
                places = range(0, n, half) if n <= half * STRETCHES else [j * (n - half) // (STRETCHES - 1) for j in range(STRETCHES)]
                rows += [(ids[first + d], langs[first + d], buf[starts[at + k] : ends[at + min(n, k + half) - 1]].tobytes()) for k in places]
            doc, lang, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lang, pa.string()), pa.array(text, pa.binary())], ["doc_id", "lang", "text"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Learns from ``docs(doc_id, text, lang)``: the lexicon counts the words of all of them, the weights are fitted on
    stretches from anywhere in the texts of a bounded sample, with as many documents for each language. None if there is nothing to learn from."""
    docs = docs.where("lang is not null and text is not null")
    rows = docs.groupBy("lang").count().orderBy("lang").collect()  # the label set
    langs = [r["lang"] for r in rows]
    if not langs:
        return None
    most = max(1, sample_docs // len(langs))
    shares = {r["lang"]: min(1.0, 0.95 * most / r["count"]) for r in rows}
    size = BUCKETS // SLICES * len(langs)
    parts = docs.select("text", "lang").mapInArrow(_count_words(langs), "slice int, part binary")
    counts = C.summed_slices(parts, SLICES, size).reshape(BUCKETS, len(langs)).astype(float)
    share = (counts + 0.5 * counts.sum(0) / max(counts.sum(), 1)) / np.maximum(counts.sum(0), 1)
    odds = np.log(share + 1e-9) - np.log(share.mean(axis=1, keepdims=True) + 1e-9)
    seen = counts.sum(axis=1, keepdims=True)
    lexicon = np.clip(odds, -4, 4) * (seen / (seen + 5))

    share = F.create_map(*(x for lang, part in shares.items() for x in (F.lit(lang), F.lit(int(part * (1 << 30))))))
    chosen = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(1 << 30)) < share[F.col("lang")])
    sample = chosen.mapInArrow(_stretches, "doc_id long, lang string, text binary").limit(sample_docs * STRETCHES).collect()
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], bytes(r["text"])))
    rng = np.random.default_rng(5)
    table = pa.RecordBatch.from_arrays([pa.array([bytes(r["text"]) for r in sample], pa.binary())], ["text"])
    target = np.array([langs.index(r["lang"]) for r in sample])
    affixes, grams, lexes, golds = [], [], [], []
    for first, rows, buf, offsets in C.text_blocks(table):
        words = Words(buf, offsets)
        aff, lex, gram = words.affixes(), words.lexicon(), words.grams()
        ends = np.cumsum(words.count)
        for d in np.flatnonzero(words.count):
            some = slice(int(ends[d] - words.count[d]), int(ends[d]))
            affixes.append(aff[some]), lexes.append(lex[some]), golds.append(target[first + d])
            grams.append([gram[x : max(x, y - 2)] for x, y in zip(words.starts[some], words.ends[some], strict=True)])
    n = len(langs)
    model = {"langs": langs, "bias": np.zeros(n), "affix": np.zeros((BUCKETS, n), np.float32), "gram": np.zeros((BUCKETS, n), np.float32), "lexicon": lexicon.astype(np.float32), "stay": np.eye(n) * 2.0}
    squares = {k: np.full(model[k].shape, 1e-3) for k in ("bias", "affix", "gram", "stay")}
    weight, weight_square = 0.5, 1e-3
    for step in range(160 if len(golds) > 1 else 0):
        left, right = rng.integers(0, len(golds), 48), rng.integers(0, len(golds), 48)
        pick = np.stack([left, np.where(rng.random(48) < 0.5, left, right)], axis=1).ravel()
        aff = np.concatenate([affixes[p] for p in pick])
        lex = np.concatenate([lexes[p] for p in pick])
        sizes = np.array([len(lexes[p]) for p in pick])
        gold = np.repeat([golds[p] for p in pick], sizes)
        gram = [g for p in pick for g in grams[p]]
        size = np.array([len(g) for g in gram])
        flat = np.concatenate(gram) if size.sum() else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(gold)), size)
        per = 1.0 / np.maximum(size, 1)[word]
        score = model["bias"] + model["affix"][aff].sum(axis=1) + weight * lexicon[lex]
        for k in range(n):
            score[:, k] += np.bincount(word, model["gram"][flat, k] * per, len(gold))
        trans = np.exp(model["stay"])
        lengths = sizes.reshape(-1, 2).sum(axis=1)
        expected, seen_pairs = np.zeros((n, n)), np.zeros((n, n))
        post = marginals(score, lengths, trans, expected)
        error = (np.eye(n)[gold] - post) / len(pick)
        inside = np.ones(len(gold), dtype=bool)
        inside[np.cumsum(lengths) - 1] = False
        pair = np.flatnonzero(inside)
        np.add.at(seen_pairs, (gold[pair], gold[pair + 1]), 1)
        grads = {"bias": error.sum(0), "stay": (seen_pairs - expected) / len(pick)}
        for name, index, rows in (("affix", aff.ravel(), np.repeat(error, aff.shape[1], axis=0)), ("gram", flat, error[word] * per[:, None])):
            g = np.stack([np.bincount(index, rows[:, k], BUCKETS) for k in range(n)], axis=1)
            grads[name] = g - 1e-6 * model[name]
        for name, g in grads.items():
            squares[name] += g * g
            model[name] = model[name] + (0.2 * g / np.sqrt(squares[name])).astype(model[name].dtype)
        g = float((error * lexicon[lex]).sum())
        weight_square += g * g
        weight = max(0.1, weight + 0.1 * g / weight_square**0.5)
    model["lexicon"] = (lexicon * weight).astype(np.float32)
    model["bias"] = model["bias"].astype(np.float32)
    model["stay"] = np.exp(np.clip(model["stay"], -6, 6))
    return model


def label_documents(buf: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(label or -1, score) of the documents of a block: the posterior mass over their words."""
    words = Words(buf, offsets)
    docs = len(offsets) - 1
    mass = np.zeros((docs, len(model["langs"])))
    at = np.concatenate([[0], np.cumsum(words.count)])
    d0 = 0
    while d0 < docs:
        d1 = max(d0 + 1, int(np.searchsorted(at, at[d0] + GROUP_WORDS, side="right")) - 1)
        lo, hi = int(at[d0]), int(at[d1])
        if hi > lo:
            post = marginals(emissions(words, model, lo, hi), words.count[d0:d1], model["stay"])
            for k in range(mass.shape[1]):
                mass[d0:d1, k] = np.bincount(words.doc[lo:hi] - d0, post[:, k], d1 - d0)
        d0 = d1
    best = mass.argmax(axis=1)
    share = mass[np.arange(docs), best] / np.maximum(words.count, 1)
    return np.where(words.count > 0, best, -1), np.where(words.count > 0, np.clip(share, 0, 1), 0.0)


def identify(docs: DataFrame, learn_from: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs(doc_id, text, ...)``.

    A null text, or one without a letter, is ``und`` with score 0; so is everything if there is nothing to learn from. Very
    long texts are labelled whole; of labels with equal mass the first in order of name is taken.
    Repeated rows are labelled alike, a null doc_id stays null, an empty table gives no rows, further columns are not used.
    """
    model = train(learn_from, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for first, rows, buf, offsets in C.text_blocks(batch):
                best, score = label_documents(buf, offsets, model) if model else (np.full(rows, -1), np.zeros(rows))
                plain = C.per_document(((buf | 32) >= 97) & ((buf | 32) <= 122), offsets) > 0
                for k in np.flatnonzero(~plain & (best >= 0)):  # no ASCII letter: is any character a letter?
                    if not any(c.isalpha() for c in texts[first + int(k)].as_py()):
                        best[k], score[k] = -1, 0.0
                names = [model["langs"][b] if b >= 0 else "und" for b in best]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    out = identify(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
