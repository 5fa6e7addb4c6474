"""Benchmark decontamination: random-walk embedding, bit sampling over item-sized windows, and exact edit verification.

A window's walk embeds its text so that few edits leave most symbols equal (edits become differing places). Samples of the
symbols are keys of hash tables that hold the items' walks, repeated until a leak is found with the wanted recall. Windows
that meet an entry are screened by the agreement of the whole walks and by the edits of up to 64 characters around, all at
once; what is left is verified against the whole item.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C

#: A passage is a leak at this similarity (1 - edits / item length) or more.
SIMILARITY = 0.8
#: An item of fewer words or bytes is looked for as it stands, on word bounds: edits would be too loose. In scripts without
#: spaces a character counts as a word.
MIN_WORDS, MIN_CHARS = 5, 20
#: Symbols that characters are folded to, and bits of a table's slots.
SYMBOLS, TABLE_BITS = 32, 17
#: Share of a walk's symbols that a window and an entry agree on.
AGREEMENT = 0.45
#: Characters of an item that are searched around a window, first few and then more (machine words), share of them that may
#: be edited, and places by which a window may lie beside its entry.
PARTS, PART_EDITS, SLACK = (32, 64), 0.32, 12
#: Windows at a time, candidates at a time, those gathered for the search, and those searched at once.
TILE, CANDIDATES, GATHERED, BATCH = 8192, 1 << 19, 1 << 15, 4096
#: Item bytes that travel with a task; a larger benchmark is searched in several passes, one after the other.
SHARD_BYTES = 1 << 19

_U = np.uint64
# lower case; letters, digits and bytes of other scripts stay, the rest becomes a space
_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[48:58], _NORMAL[97:123], _NORMAL[65:91], _NORMAL[128:] = range(48, 58), range(97, 123), range(97, 123), range(128, 256)
# symbols: 1 a space, then letters and digits; 0 is no character
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[32], _SYMBOL[97:123], _SYMBOL[48:58], _SYMBOL[128:] = 1, range(2, 28), 28 + np.arange(10) % 4, 2 + np.arange(128) % 30


class Windows(NamedTuple):
    """How items of ``shortest`` characters or more, up to those of the next class, are looked for."""

    shortest: int
    #: Steps of a walk, which takes up about half as many characters.
    steps: int
    #: Characters of a text of which the first start opens a window.
    stride: int
    #: Walks, tables of each, and sampled symbols of a table's key.
    walks: int
    tables: int
    symbols: int


#: By length of the items; repetitions are set by the recall measured on edited items (tests/llm/test_documents.py).
CLASSES = (Windows(0, 40, 1, 4, 24, 5), Windows(48, 48, 6, 2, 20, 6), Windows(80, 40, 8, 1, 22, 7), Windows(128, 56, 16, 1, 24, 7))


def normalized(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal bytes with runs of spaces as one, and the documents' new offsets."""
    out = _NORMAL[buf]
    if len(out) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        out[1:][latin] += 0x20
    space = out == 32
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    counts = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum(keep, out=counts[1:])
    return out[keep], counts[offsets]


def normal_text(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalized(raw, np.array([0, len(raw)]))[0]


def symbols(text: np.ndarray) -> np.ndarray:
    return _SYMBOL[text]


def starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where windows may start: at words, at characters of scripts without spaces, and at documents."""
    at = np.ones(len(text), dtype=bool)
    at[1:] = text[:-1] == 32
    at |= text >= 0xE0
    at[offsets[:-1][offsets[:-1] < len(text)]] = True
    return np.flatnonzero(at & (text != 32))


class Walk:
    """A random walk that embeds strings: each step hands on the symbol it stands at and, by a bit of the step and the symbol,
    stays or moves on. After an edit the walks of two strings soon fall into step again, so few edits leave most symbols equal."""

    def __init__(self, steps: int, seed: int):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (steps, SYMBOLS)).astype(np.int64)

    def __call__(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row for each step, a column for each start; a walk that leaves the text stays at its last symbol."""
        out, place = np.empty((len(self.moves), len(at)), np.uint8), at.copy()
        for k, move in enumerate(self.moves):
            text.take(place, out=out[k], mode="clip")
            place += move.take(out[k], mode="clip")
        return out


class Index:
    """The items of a class: walks from all of their starts, in tables by sampled symbols."""

    def __init__(self, texts: list[tuple[int, np.ndarray]], plan: Windows, seed: int):
        self.plan = plan
        item, at, parts, pad = [], [], [], np.zeros(plan.steps, np.uint8)
        for k, text in texts:
            here = starts(text, np.array([0, len(text)]))
            here = here[(here <= len(text) - plan.steps // 2) | (here == here[0])]
            item.append(np.full(len(here), k)), at.append(here), parts.append((text, here))
        self.item, self.at = np.concatenate(item), np.concatenate(at)
        rng = np.random.default_rng(seed)
        self.walks = []
        for w in range(plan.walks):
            walk = Walk(plan.steps, seed + w + 1)
            own = np.concatenate([walk(np.concatenate([symbols(t), pad]), s) for t, s in parts], axis=1)
            tables = []
            for _ in range(plan.tables):  # a sample takes a symbol from each stretch of the walk
                picks = [int(rng.integers(k * plan.steps // plan.symbols, (k + 1) * plan.steps // plan.symbols)) for k in range(plan.symbols)]
                key = _sampled(own, picks)
                order = np.argsort(key, kind="stable")
                some = np.zeros(1 << TABLE_BITS, dtype=bool)
                some[_slot(key)] = True
                tables.append((picks, key[order], order, some))
            self.walks.append((walk, np.ascontiguousarray(own.T), tables))

    def candidates(self, text: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, entry) of the windows that share a sample with an entry and agree with it on a good part of the walk."""
        least = AGREEMENT * self.plan.steps
        for lo in range(0, len(begin), TILE):
            at = begin[lo : lo + TILE]
            seen = []
            for walk, own, tables in self.walks:
                embedded = walk(text, at)
                rows, turned = [], None
                for picks, keys, entries, some in tables:
                    key = _sampled(embedded, picks)
                    hit = np.flatnonzero(some.take(_slot(key), mode="clip"))
                    if not len(hit):
                        continue
                    first, last = (np.searchsorted(keys, key[hit], side=s) for s in ("left", "right"))
                    count = last - first
                    ends = np.cumsum(count)
                    for a, b in _shares(ends, CANDIDATES):
                        rows.append((np.repeat(hit[a:b], count[a:b]), entries[C.ragged(first[a:b], count[a:b])]))
                        if sum(len(r[0]) for r in rows) >= CANDIDATES:
                            turned = np.ascontiguousarray(embedded.T) if turned is None else turned
                            seen.append(_agreeing(turned, own, rows, least))
                            rows = []
                if rows:
                    turned = np.ascontiguousarray(embedded.T) if turned is None else turned
                    seen.append(_agreeing(turned, own, rows, least))
            if seen:
                pairs = np.unique(np.concatenate(seen))
                yield at[pairs // len(self.item)], pairs % len(self.item)


def _sampled(embedded: np.ndarray, picks: list[int]) -> np.ndarray:
    key = embedded[picks[0]].astype(np.uint32)
    for p in picks[1:]:
        key <<= np.uint32(5)
        key |= embedded[p]
    return key


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)


def _shares(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``most`` of what adds up to ``ends``."""
    at = 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to
        at = to


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays put together to ``least`` elements or more, so that each step of the search does much at once."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _agreeing(windows: np.ndarray, entries: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Of (window, entry) those whose walks agree on ``least`` symbols, each as one number."""
    window, entry = (np.concatenate(x) for x in zip(*rows, strict=True))
    pair = np.unique(window * len(entries) + entry)
    window, entry = pair // len(entries), pair % len(entries)
    same = np.bitwise_count((windows[window] == entries[entry]).view(np.uint64)).sum(axis=1)
    return pair[same >= least]


#: Characters of scripts without spaces between words: Thai to Tibetan, Burmese, Khmer, CJK with kana, half-width kana, further ideographs.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def word_count(text: bytes) -> int:
    """Words between spaces; each character of a script without spaces is one."""
    return len(_UNSPACED.sub(" x ", text.decode(errors="replace")).split())


def bounded(before: bytes, text: bytes, after: bytes) -> bool:
    """Whether a word ends before and after a text: at a space or an end, or at a character of a script without spaces."""
    left, own, right = (x.decode(errors="replace") for x in (before, text, after))
    return all(not a or not b or a == " " or b == " " or bool(_UNSPACED.match(a) or _UNSPACED.match(b)) for a, b in ((left[-1:], own[:1]), (own[-1:], right[:1])))


def edit_distance(pattern: bytes, text: bytes) -> int:
    """Fewest edits that turn the pattern into some substring of the text (bit-parallel)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        h_up, h_down = down | (~(d | up) & full), up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full
        h_down = h_down << 1 & full
        down = h_up & d
        up = h_down | (~(h_up | d) & full)
        if score < best:
            best = score
    return best


class Items:
    """The items of a shard, ready for lookup."""

    def __init__(self, rows: tuple[tuple[int, str], ...], similarity: float = SIMILARITY):
        texts = [(i, normal_text(t).tobytes().strip()) for i, t in rows]
        texts = [(i, t) for i, t in texts if t]
        self.ids = [i for i, _ in texts]
        self.texts = [t for _, t in texts]
        short = [word_count(t) < MIN_WORDS or len(t) < MIN_CHARS for t in self.texts]
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: hashes and items
        for size in sorted({len(t) for t, s in zip(self.texts, short, strict=True) if s}):
            some = np.array([k for k, t in enumerate(self.texts) if short[k] and len(t) == size])
            h = np.concatenate([C.range_hash(C.byte_sums(np.frombuffer(self.texts[k], np.uint8)), np.array([0]), np.array([size])) for k in some.tolist()])
            order = np.argsort(h, kind="stable")
            self.exact[size] = h[order], some[order]
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.most = ((1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        self.indexes = []
        for n, plan in enumerate(CLASSES):
            end = CLASSES[n + 1].shortest if n + 1 < len(CLASSES) else np.inf
            own = [(k, np.frombuffer(t, np.uint8)) for k, t in enumerate(self.texts) if not short[k] and plan.shortest <= len(t) < end]
            if own:
                self.indexes.append(Index(own, plan, 100 * n))
        # for each item and symbol the item's places as bits, in words of 64 with one to spare
        self.first = np.concatenate([[0], np.cumsum((self.lengths + 63) // 64 + 1)])
        self.bits = np.zeros((SYMBOLS, int(self.first[-1])), dtype=np.uint64)
        for k, text in enumerate(self.texts):
            at, sym = np.arange(len(text)), symbols(np.frombuffer(text, np.uint8))
            np.bitwise_or.at(self.bits, (sym, self.first[k] + at // 64), _U(1) << (at % 64).astype(np.uint64))

    def _part_bits(self, item: np.ndarray, place: np.ndarray, size: np.ndarray, part: int) -> np.ndarray:
        """Places of each symbol in the items' parts, as bits whose highest is a part's last; below a part, bits match all."""
        word, shift = self.first[item] + place // 64, (place % 64).astype(np.uint64)
        low, high = self.bits[:, word] >> shift, self.bits[:, word + 1] << ((_U(64) - shift) & _U(63))
        high[:, shift == 0] = 0
        spare = (part - size).astype(np.uint64)
        bits = ((low | high) << spare) | ((_U(1) << spare) - _U(1))
        return np.ascontiguousarray(bits.astype(np.uint32 if part == 32 else np.uint64).T)

    def _near(self, sym: np.ndarray, item: np.ndarray, place: np.ndarray, begin: np.ndarray, part: int) -> np.ndarray:
        """Those whose part of the item, expected at ``begin``, is there within its edits (bit-parallel, as edit_distance)."""
        word = np.uint32 if part == 32 else np.uint64
        good = []
        for lo in range(0, len(item), BATCH):
            some = slice(lo, lo + BATCH)
            size = np.minimum(part, self.lengths[item[some]] - place[some])
            bits = self._part_bits(item[some], place[some], size, part).ravel()
            at = begin[some] - SLACK
            rows = np.arange(len(size)) * SYMBOLS
            score = size.astype(word)
            low, one, end = score.copy(), word(1), word(part - 1)
            up, down = (_U(0xFFFFFFFFFFFFFFFF) << (part - size).astype(np.uint64)).astype(word), np.zeros(len(size), dtype=word)
            byte, (eq, d, x, h_up, h_down) = np.empty(len(size), np.uint8), (np.empty_like(up) for _ in range(5))
            where = np.empty_like(rows)
            for _ in range(int(size.max()) + 2 * SLACK):
                sym.take(at, out=byte, mode="clip")
                at += 1
                np.add(rows, byte, out=where)
                bits.take(where, out=eq, mode="clip")
                eq |= down  # x
                np.bitwise_and(eq, up, out=d)
                d += up
                d ^= up
                d |= eq
                np.bitwise_or(d, up, out=h_up)
                np.invert(h_up, out=h_up)
                h_up |= down
                np.bitwise_and(up, d, out=h_down)
                np.right_shift(h_up, end, out=x)
                score += x
                np.right_shift(h_down, end, out=x)
                score -= x
                h_up <<= one
                h_down <<= one
                np.bitwise_and(h_up, d, out=down)
                np.bitwise_or(h_up, d, out=up)
                np.invert(up, out=up)
                up |= h_down
                np.minimum(low, score, out=low)
            good.append(lo + np.flatnonzero(low.astype(np.int64) <= PART_EDITS * size))
        return np.concatenate(good) if good else np.zeros(0, np.int64)

    def _copies(self, text: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
        """No edits, by (document, item), for each short item that stands in a document on word bounds."""
        out: dict[tuple[int, int], int] = {}
        sums = C.byte_sums(text) if self.exact else None
        for size, (hashes, items) in self.exact.items():
            at = np.arange(max(0, len(text) - size + 1))
            h = C.range_hash(sums, at, at + size)
            low, high = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
            for place in np.flatnonzero(high > low).tolist():
                doc = int(C.owner(place, offsets))
                a, b = int(offsets[doc]), int(offsets[doc + 1])
                for k in items[low[place] : high[place]].tolist():
                    if (doc, k) not in out and place + size <= b and text[place : place + size].tobytes() == self.texts[k]:
                        if bounded(text[max(a, place - 4) : place].tobytes(), self.texts[k], text[place + size : min(b, place + size + 4)].tobytes()):
                            out[doc, k] = 0
        return out

    def leaks(self, text: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
        """Edits by (document, item) of the leaks that are found."""
        out = self._copies(text, offsets)
        if not self.indexes or not len(text):
            return out
        sym = np.concatenate([symbols(text), np.zeros(max(PARTS), np.uint8)])
        begin = starts(text, offsets)
        spans = []
        for index in self.indexes:
            cell = begin // index.plan.stride
            mine = begin[np.concatenate([[True], cell[1:] != cell[:-1]])] if len(begin) else begin
            for at, entry in _gathered(index.candidates(sym, mine), GATHERED):
                item, place = index.item[entry], index.at[entry]
                for part in PARTS:
                    # the part that starts where the entry does, or earlier if the item ends too soon
                    first = np.clip(self.lengths[item] - part, 0, place)
                    good = self._near(sym, item, first, at - place + first, part)
                    at, item, place = at[good], item[good], place[good]
                doc = C.owner(at, offsets)
                reach = self.most[item] + SLACK
                low, high = np.maximum(offsets[doc], at - place - reach), np.minimum(offsets[doc + 1], at - place + self.lengths[item] + reach)
                spans.append(np.stack([doc, item, low, high], axis=1)[high - low >= self.lengths[item] - self.most[item]])
        regions = np.unique(np.concatenate(spans), axis=0).tolist() if spans else []
        merged: list[list[int]] = []
        for doc, k, a, b in regions:
            if merged and merged[-1][:2] == [doc, k] and a <= merged[-1][3]:
                merged[-1][3] = max(b, merged[-1][3])
            else:
                merged.append([doc, k, a, b])
        for doc, k, a, b in merged:
            if out.get((doc, k)) == 0:
                continue
            edits = edit_distance(self.texts[k], text[a:b].tobytes())
            if edits <= self.most[k]:
                out[doc, k] = min(edits, out.get((doc, k), edits))
        return out


@lru_cache(maxsize=2)
def _items(rows: tuple[tuple[int, str], ...], similarity: float = SIMILARITY) -> Items:
    return Items(rows, similarity)


def _shards(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in shards of bounded size, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null and text <> ''").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // SHARD_BYTES))
    shards = 1 if parts == 1 else 2 * parts
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    for k in range(shards):
        yield tuple(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in dealt.where(F.col("shard") == k).collect()))


def _passes(benchmark: DataFrame, one: Callable[[tuple[tuple[int, str], ...]], DataFrame], tag: str) -> Iterator[DataFrame]:
    """A table for each shard; if there are several, each is written before the next shard is fetched, so the driver holds one."""
    shards = _shards(benchmark)
    held = next(shards)
    for rows in shards:
        yield C.materialize(one(held), tag)
        held = rows
    yield one(held)


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, item_chars, edits and similarity of every (document, item) of which the document holds a leak.

    Texts are compared lower-cased, with runs of anything but letters and digits as one space. Every pair is verified; more
    than nine in ten of the leaks are found, whatever an item's length and however its edits are spread, and all but a few
    at half of the edits. A null or empty text holds no leak; items of fewer than five words or twenty bytes are looked for
    as they stand, on word bounds; very long texts are searched whole, very long items from all of their starts; repeated rows
    and items give a pair once; a null doc_id stays null and a null item_id becomes -1; empty tables give no rows; further
    columns are not used.
    """

    def search(rows: tuple[tuple[int, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(rows, similarity)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for first, _, buf, offsets in C.text_blocks(batch):
                    got = items.leaks(*normalized(buf, offsets))
                    if got:
                        yield pa.RecordBatch.from_pylist(
                            [{"doc_id": ids[first + d], "item_id": items.ids[i], "item_chars": int(items.lengths[i]), "edits": e} for (d, i), e in got.items()],
                            pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_chars", pa.int64()), ("edits", pa.int64())]),
                        )

        return run

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = _passes(benchmark, lambda rows: texts.mapInArrow(search(rows), "doc_id long, item_id long, item_chars long, edits long"), "leaks")
    out = reduce(DataFrame.unionByName, found)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "item_chars")).alias("m"))
    return best.select("doc_id", "item_id", "m.item_chars", "m.edits", (1 - F.col("m.edits") / F.col("m.item_chars")).alias("similarity"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(C.documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that hold a leak go; the others pass with all their columns, without a shuffle.

    A null or empty text holds no leak and stays; repeated rows are judged alike, each; a null doc_id has no part in it; very
    long texts are searched whole; an empty table or benchmark changes nothing; further columns pass, whatever their names.
    """

    def screen(rows: tuple[tuple[int, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(rows)
            for batch in batches:
                for first, count, buf, offsets in C.text_blocks(batch):
                    good = np.ones(count, dtype=bool)
                    good[[d for d, _ in items.leaks(*normalized(buf, offsets))]] = False
                    yield batch.slice(first, count).filter(pa.array(good))

        return run

    kept = docs

    def one(rows: tuple[tuple[int, str], ...]) -> DataFrame:
        return kept.mapInArrow(screen(rows), docs.schema)

    for kept in _passes(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), one, "unleaked"):
        pass
    return kept
