"""License scans: an automaton finds tags and notices, a shunting-yard parser evaluates the expressions behind the tags."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyplan.llm import common

# Phrases and labels of the base.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: How freely a text may be used under a licence: 1 permissive, .6 share-alike of files, .4 share-alike of works, .2 for
#: non-commercial or unchanged use only, 0 all rights reserved or not known.
FREEDOM = {
    "mit": 1.0,
    "apache-2": 1.0,
    "apache-2.0": 1.0,
    "bsd-2-clause": 1.0,
    "bsd-3-clause": 1.0,
    "isc": 1.0,
    "zlib": 1.0,
    "unlicense": 1.0,
    "cc0-1.0": 1.0,
    "cc-by": 1.0,
    "cc-by-4.0": 1.0,
    "mpl-2.0": 0.6,
    "lgpl": 0.6,
    "lgpl-2.1": 0.6,
    "lgpl-3.0": 0.6,
    "epl-2.0": 0.6,
    "gpl": 0.4,
    "gpl-2.0": 0.4,
    "gpl-3.0": 0.4,
    "agpl-3.0": 0.4,
    "cc-by-sa": 0.4,
    "cc-by-sa-4.0": 0.4,
    "cc-by-nc": 0.2,
    "cc-by-nc-4.0": 0.2,
    "cc-by-nd": 0.2,
    "cc-by-nc-sa": 0.2,
    "cc-by-nc-nd": 0.2,
    "all-rights-reserved": 0.0,
}

#: Notices beside the base phrases; of notices that start in one place the longest counts.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache-2.0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "zlib license": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0-1.0",
    "cc0": "cc0-1.0",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu affero general public license": "agpl-3.0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "all rights reserved": "all-rights-reserved",
}

#: Words of the tags that an expression follows.
TAGS = ("spdx license identifier", "license expression")

#: ``with`` adds this to a licence's freedom (an exception permits more), up to 1.
EXCEPTION = 0.2
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_ALIASES = {"apache-2": "apache-2.0", "gpl-2.0-only": "gpl-2.0", "gpl-3.0-only": "gpl-3.0", "lgpl-2.1-only": "lgpl-2.1", "lgpl-3.0-only": "lgpl-3.0", "agpl-3.0-only": "agpl-3.0"}

_LABELS = NOTICES | BASE
#: Signs between words become spaces, A-Z become small.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPACED = "".join(chr(c) for c in _BYTES[:128])


class Expression(NamedTuple):
    """An evaluated expression: its licence names, sorted, how free they make the text, and whether all are known."""

    labels: tuple[str, ...]
    freedom: float
    known: bool


def spaced(text: str | None) -> str:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, a space before each and one at the end."""
    return re.sub(b"  +", b" ", b" " + (text or "").encode().translate(_BYTES) + b" ").decode()


def tokens_at(text: str, at: int) -> tuple[list[str], int]:
    """The tokens that may make an expression from a place on, and where they end: at the line's end, at the first other sign,
    or before the second of two operands in a row, where prose begins."""
    out, ends, operand = [], [at], False
    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        operator = token.lower() in _STRENGTH
        if (operand and not operator and token != ")") or ((operator or token == ")") and not operand):
            break
        operand = token == ")" or not (operator or token == "(")
        out.append(token.rstrip(".:") if operand and token != ")" else token)
        ends.append(at)
    while out and out[-1].lower() in (*_STRENGTH, "("):
        out.pop()
        ends.pop()
    return out, ends[-1]


def licence_name(token: str) -> str:
    """The label of an identifier: lower case, without a mark for later versions."""
    name = token.lower().removesuffix("+").removesuffix("-or-later")
    return _ALIASES.get(name, name)


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in the order of evaluation; ``with`` binds closest, then ``and``, then ``or``,
    all from the left. None if parentheses or operands don't match."""
    out, stack, depth = [], [], 0
    for token in tokens:
        kind = token.lower()
        if kind in _STRENGTH:
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[kind]:
                out.append(stack.pop())
            stack.append(kind)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            out.append(token)
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    for token in out:
        depth += -1 if token in _STRENGTH else 1
        if depth < 1:
            return None
    return out if depth == 1 else None


def evaluate(tokens: list[str]) -> Expression | None:
    """``and`` is as free as its least free side, ``or`` as its freest, ``with`` a little freer than the licence.

    None if the tokens make no expression. An exception is no licence, so its name is no label.
    """
    order = postfix(tokens)
    if not order:
        return None
    stack: list[tuple[frozenset[str], float, bool]] = []
    for token in order:
        if token not in _STRENGTH:
            name = licence_name(token)
            stack.append((frozenset([name]), FREEDOM.get(name, 0.0), name in FREEDOM))
            continue
        (right, b, known_b), (left, a, known_a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, min(1.0, a + EXCEPTION) if known_a else 0.0, known_a))
        else:
            stack.append((left | right, min(a, b) if token == "and" else max(a, b), known_a and known_b))
    labels, freedom, known = stack[0]
    return Expression(tuple(sorted(labels)), freedom, known)


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*_LABELS, *TAGS]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def found_phrases(words: str) -> list[tuple[int, str]]:
    """(start word, phrase) of every phrase in a spaced text, overlapping ones included."""
    out, word, at = [], 0, 0
    for end, phrase in _automaton().iter(words):
        start = end - len(phrase) - 1
        # counted on from the last match, which begins a few words later at most
        word += words.count(" ", at, start) if start >= at else -words.count(" ", start, at)
        at = start
        out.append((word, phrase))
    return out


_TAG = re.compile(r"(?<![^ ])(?:" + "|".join(" +".join(tag.split()) for tag in TAGS) + r")(?= ) *")
_SIGNS = re.compile("[ \t:=\"']*")


_WORD = re.compile("[^ ]+")


def expressions_of(text: str) -> list[tuple[Expression, int, int]]:
    """The expressions behind the tags of a text, each with its first word and the word after its last; a tag without one has none."""
    signs = text.translate(_SPACED) + " "  # as long as the text, so places are the same
    out, word, at = [], 0, 0
    for m in _TAG.finditer(signs):
        begin = _SIGNS.match(text, m.start() + len(m[0].rstrip())).end()
        tokens, end = tokens_at(text, begin)
        if (found := evaluate(tokens)) is not None:
            word += sum(1 for _ in _WORD.finditer(signs, at, begin))
            last = word + sum(1 for _ in _WORD.finditer(signs, begin, end))
            out.append((found, word, last))
            word, at = last, end
    return out


class Scan(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    n_notices: int
    n_expressions: int


def scan(text: str | None) -> Scan:
    """All findings of one whole text."""
    words = spaced(text)
    hits = found_phrases(words)
    places = [k for k, p in hits if p in BASE]
    spans = expressions_of(text) if any(p in TAGS for _, p in hits) else []
    found = [e for e, _, _ in spans]
    within = {k for _, a, b in spans for k in range(a, b)}
    longest: dict[int, str] = {}
    for k, p in hits:
        if p not in TAGS and k not in within:
            longest[k] = max(longest.get(k, ""), p, key=len)
    stated = [_LABELS[p] for p in longest.values()]
    base = {BASE[p] for _, p in hits if p in BASE}
    labels = base.union(stated, *(e.labels for e in found))
    freedom = [FREEDOM[x] for x in stated] + [e.freedom for e in found]
    return Scan(words.count(" ") - 1, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(freedom, default=0.0), len(longest), len(found))


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "n_notices": pa.int64(), "n_expressions": pa.int64()}
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(text.as_py()) for text in batch.column(1)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, _FIELDS.values(), strict=True))], [batch.schema.names[0], *_FIELDS])


def scan_licenses(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its words, the places of base phrases with the first and last of them, labels, and a score.

    ``score`` says how freely the text may be used by what it states itself: all its notices and expressions hold together, so
    the least free one counts; 0 where nothing is stated, since nothing is granted. Unknown identifiers behind a tag are labels
    of freedom 0. n_notices counts places (of those that start at one word the longest; names within an expression are none),
    n_expressions evaluated tags.

    Null and empty texts have no words, null first and last places, empty labels and score 0. Repeated rows and identities are
    scanned each; a null identity is kept. Texts are scanned whole, in linear time, and columns of other names aren't read. An
    empty table gives no rows.
    """
    kind = T.StructType([T.StructField(identity, docs.schema[identity].dataType)])
    for name, of in _FIELDS.items():
        kind = kind.add(name, _KINDS[of])
    return docs.select(identity, F.col(text).cast("string")).mapInArrow(_scanned, kind)


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scans of all documents; see scan_licenses()."""
    return scan_licenses(common.documents(spark, sf_dir, "doc_id", "text"))
