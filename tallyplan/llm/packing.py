"""Packing: best-fit decreasing with a segment tree over the open windows' remaining capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyplan.llm import common as C

WINDOW = 2048
#: The id that ends every document.
END_ID = 1
#: Words whose ids a worker remembers at least (at most two times as many), and the bytes of the longest of them.
CACHE_WORDS, CACHE_LENGTH = 250_000, 48
#: Bytes of text whose words are looked up together.
BLOCK_BYTES = 1 << 20
#: Words that go to the tokenizer as one text.
JOINED_WORDS = 8_192
#: Pieces that are packed together: bounds a packer's memory, and is large enough that windows left open hardly count.
GROUP_PIECES = 1 << 15
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

_STATE: dict = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Marks that the tokenizer parts from the letters before them as one run.
_TAIL = b".,!?;:%*#&$|"


class WordEncoder:
    """Ids of words, remembered. White space always parts the tokenizer's words, so the ids of a text are those of its words.

    Words of letters alone end in a token that the vocabulary marks as a word's end, so many go to the tokenizer as one
    text and their ids are told apart by that mark; should the count not agree, and for all other words, each goes alone.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def alone(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.asarray(g.ids, dtype="<u4").tobytes() for g in got]

    def lettered(self, words: list[bytes]) -> list[bytes]:
        ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or (len(at) and at[-1] != len(ids)):
            return self.alone(words)
        raw = ids.tobytes()
        cut = (at * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def ids_of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Those met of late are remembered; when they are many, the ones not met since are forgotten."""
        recent, older, out, plain, tailed, whole = self.recent, self.older, {}, [], {}, []
        for w in words:
            ids = recent.get(w)
            if ids is None:
                ids = older.get(w)
                if ids is not None:
                    recent[w] = ids
                else:
                    stem = w.rstrip(_TAIL)
                    if not stem or not (stem.isalpha() or not stem.isascii() and stem.decode().isalpha()):
                        whole.append(w)
                    elif len(stem) == len(w):
                        plain.append(w)
                    else:
                        tailed[w] = stem
                    continue
            out[w] = ids
        fresh = {}
        for at in range(0, len(plain), JOINED_WORDS):
            some = plain[at : at + JOINED_WORDS]
            fresh.update(zip(some, self.lettered(some), strict=True))
        if tailed:
            parts = self.ids_of({*tailed.values(), *(w[len(stem) :] for w, stem in tailed.items())})
            fresh.update((w, parts[stem] + parts[w[len(stem) :]]) for w, stem in tailed.items())
        if whole:
            fresh.update(zip(whole, self.alone(whole), strict=True))
        out.update(fresh)
        self.recent.update(fresh if max(map(len, fresh), default=0) <= CACHE_LENGTH else {w: i for w, i in fresh.items() if len(w) <= CACHE_LENGTH})
        if len(self.recent) > CACHE_WORDS:
            self.recent, self.older = {}, self.recent
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers, with the closing id."""
        split = [(t if b"<|" in t else t.translate(_LOWER)).split() for t in texts]  # bytes.split parts at space and 9 to 13
        words: set[bytes] = set()
        for some in split:
            words.update(some)
        ids = self.ids_of(words)
        end = np.array([END_ID], "<u4").tobytes()
        return [b"".join(map(ids.__getitem__, some)) + end for some in split]


def encoder(path: str) -> WordEncoder:
    if _STATE.get("path") != path:
        _STATE.update(path=path, encoder=WordEncoder(path))
    return _STATE["encoder"]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << (window - 1).bit_length() << 1
        self.tree = [0] * (2 * self.size)
        self.stacks: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        if room <= 0:
            return
        self.stacks.setdefault(room, []).append(window)
        k = room + self.size
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for ``need``; it is closed."""
        k = need + self.size
        tree = self.tree
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.size
        window = self.stacks[room].pop()
        while k:
            tree[k] -= 1
            k >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece of at most ``window`` tokens; windows count from 0, in order of opening."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, opened = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = open_.take(need)
        if found is None:
            found, opened = (window, opened), opened + 1
        room, at = found
        where[k], offset[k] = at, window - room
        open_.add(room - need, at)
    return where, offset


def pieces(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document: full windows, then the rest."""
    total = len(ids) // 4
    return [(at, min(window, total - at), zlib.crc32(ids[4 * at : 4 * min(total, at + window)])) for at in range(0, total, window)]


def cut_pieces(docs: DataFrame, window: int, path: str) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``, each with a number of its own; written once, so the numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, rows, buf, offsets in C.text_blocks(batch, limit=BLOCK_BYTES):
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                held = []
                for doc_id, ids in zip(doc_ids[first : first + rows], encoder(path)(texts), strict=True):
                    held += [(doc_id, start, length, crc, len(ids) // 4) for start, length, crc in pieces(ids, window)]
                for at in range(0, len(held), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held[at : at + 20_000], strict=True)], PIECE)

    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in PIECE))
    return C.materialize(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def _place(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows in order of their group: each group is packed by itself."""
        group, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables([pa.Table.from_batches([h]) for h in held]).combine_chunks()
            where, offset = best_fit_decreasing(np.asarray(table.column("length")), window)
            sequence = ((np.int64(group) << 32) + where) * 2 + 1
            out = table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            return iter(out.to_batches(max_chunksize=20_000))

        for batch in batches:
            key = np.asarray(batch.column("group"))
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
                if held and key[a] != group:
                    yield from flush()
                    held.clear()
                group = int(key[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Packs ``docs(doc_id, text, ...)`` into windows of ``window`` tokens.

    Each document's ids and a closing id are cut into full windows, which are sequences of their own, and a rest. The rests
    of the whole table are dealt by a hash of their numbers into groups of about ``GROUP_PIECES``, however the table is
    divided, and each group is placed by best-fit decreasing. A null or empty text is its closing id alone; very long texts
    are cut like any other; repeated rows are packed each; a null doc_id stays null; an empty table gives no rows; further
    columns are not used.
    """
    cut = cut_pieces(docs, window, path or tokenizer_path())
    groups = 1 + cut.where(F.col("length") < window).count() // GROUP_PIECES
    full = cut.where(F.col("length") == window).select(*PIECE, (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut.where(F.col("length") < window).select(*PIECE, F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"))
    dealt = rests.repartition("group").sortWithinPartitions("group")
    placed = dealt.mapInArrow(_place(window), ", ".join(f"{c} long" for c in (*PIECE, "sequence_id", "offset")))
    return full.unionByName(placed)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir, "doc_id", "text"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents that are left.

    A null or empty text is its closing id; a null doc_id stays null; repeated rows are packed each; very long texts are cut
    into windows; an empty table gives no rows; further columns, whatever their names, go no further.
    """
    return pack(docs)
