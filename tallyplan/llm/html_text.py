"""Main text of web pages by template deduction: equivalence classes of tokens over a host's pages, and the slots they leave.

Tokens are elements, by their path, and blocks of text at their path. A host's tokens that share their occurrence vector over
its pages are of one class; vectors are compared by sums over the pages, so that Spark gathers the evidence of a whole host,
however large, before any page is judged. Text of a class with elements is the template's. The elements nest into a template
whose slots are the paths with text that varies; the slot of most text, with all slots of the class that encloses it, is
the article.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyplan.llm import common as C

#: Text is the template's only if so many pages hold it whose bodies differ.
AGREEING_PAGES = 8
#: A path on fewer than one in so many pages of its host has no part in the template.
RARE = 50
#: Slots of a template, by text, that a page may find its article by.
SLOTS = 16
#: An enclosing element is the article's as well if it adds at most this share to its text.
ADDED = 0.5
#: Weight of text under an article or main element when slots are ranked.
MAIN_WEIGHT = 10
#: Paths whose hashes a worker remembers.
KNOWN_PATHS = 1 << 16

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input label menu nav noscript object option script select style svg template textarea title".split()
)
# Words of class, id and role that name what isn't the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus discussion "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted "
    "promotion related replies reply responses share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe toolbar widget widgets "
    "complementary contentinfo search alert".split()
)
# Words that may stand beside these in one name and don't change what it names, as in site-footer or related-posts.
ASIDE_COMPANIONS = frozenset(
    "a area article articles aside bar block body bottom box btn button buttons card container content count desktop element entry field fixed floating form global group head heading header holder home "
    "icon icons inline inner input item items js label layer left link links list main media mobile module modules nav new news outer page pages panel popular post posts primary "
    "recent right root row secondary section site slot small sticky tags text thread title toggle top tree unit user wrap wrapper zone".split()
)
MAIN = frozenset(["article", "main"])
# Start tags that end an open element of the same list.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset(["table", "ul", "ol", "dl", "select", "article", "main", "section", "body", "html", "td", "th", "div"])

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


# Elements that hold a piece of an article, never all of it.
PIECES = frozenset("p li dd dt dl ul ol h1 h2 h3 h4 h5 h6 pre blockquote table tbody thead tfoot tr td th figure figcaption hr hgroup".split())
WHOLE = frozenset(["", "html", "body"])

_PATHS: dict[tuple[int, str], int] = {}


class Element(NamedTuple):
    name: str
    path: int
    aside: bool
    main: bool
    depth: int


_ROOT = Element("", 0, False, False, 0)


def path_hash(parent: int, mark: str) -> int:
    """A number for the path of an element, from that of its parent; 0 is the page itself."""
    got = _PATHS.get((parent, mark))
    if got is None:
        if len(_PATHS) >= KNOWN_PATHS:
            _PATHS.clear()
        got = _PATHS[parent, mark] = xxh64_intdigest(mark, parent) >> 1
    return got


def names_aside(element: str, attribute: str, value: str) -> bool:
    """Whether a class, id or role says that an element is no article. A name of several words does only if all of them are known
    to be about the page: search-box does, search-algorithms, related-work or social-science are about a subject. The id of a
    heading or another piece of an article is made from its text on most sites, so it says nothing."""
    if attribute == "id" and element in PIECES:
        return False
    for name in value.split():
        words = _WORD.findall(name)
        if any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in ASIDE_COMPANIONS for w in words):
            return True
    return False


class Page:
    """A page's elements and blocks of text outside menus, adverts and the like: paths with their number and text."""

    def __init__(self, markup: str):
        self.paths: dict[int, tuple[int, int, str, bool]] = {0: (0, 0, "", False)}  # parent, depth, name, in main
        self.counts: Counter = Counter({0: 1})
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._at = _ROOT
        self._stack: list[Element] = []
        self._open_names: Counter = Counter()
        self._parse(markup)

    def _parse(self, markup: str) -> None:
        at, n = 0, len(markup)
        while at < n:
            m = _TAG.search(markup, at)
            if not m:
                self._put(markup[at:])
                break
            self._put(markup[at : m.start()])
            at = max(m.end(), m.start() + 1)
            name = (m[2] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._put(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            if m[1]:
                self._close(name)
            else:
                self._open(name, m[3])
                if name in RAW and not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b", re.I).search(markup, at)
                    at = end.start() if end else n
        self._flush()

    def _put(self, text: str) -> None:
        if text:
            here = self._stack[-1] if self._stack else _ROOT
            if not self._text:
                self._at = here
            elif here.aside != self._at.aside or here.main != self._at.main:
                self._flush()
                self._at = here
            self._text.append(text)

    def _flush(self) -> None:
        if self._text:
            if not self._at.aside:
                text = _SPACE.sub(" ", html.unescape("".join(self._text))).strip()
                if text:
                    self.blocks.append((self._at.path, text))
            self._text = []

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
            if self._open_names["p"] and name not in ("html", "body"):
                self._drop(("p",))
            if name in SIBLINGS:
                self._drop(SIBLINGS[name])
        elif name == "br":
            self._put(" ")
        if name in VOID:
            return
        words, named = set(), False
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                value = (a[2] or a[3] or a[4] or "").lower()
                words |= set(_WORD.findall(value))
                named = named or names_aside(name, a[1].lower(), value)
        parent = self._stack[-1] if self._stack else _ROOT
        aside = parent.aside or name in ASIDE or (named and name not in ("html", "body", *MAIN))
        here = Element(name, parent.path, aside, parent.main or name in MAIN, parent.depth)
        if name in BLOCKS or name in RAW:
            path = path_hash(parent.path, name + "." + ".".join(sorted(words)) if words else name)
            here = here._replace(path=path, depth=parent.depth + 1)
            if not aside:
                self.paths.setdefault(path, (parent.path, here.depth, name, here.main))
                self.counts[path] += 1
        self._stack.append(here)
        self._open_names[name] += 1

    def _cut(self, k: int) -> None:
        for s in self._stack[k:]:
            self._open_names[s.name] -= 1
        del self._stack[k:]

    def _drop(self, names: tuple[str, ...]) -> None:
        """Closes the innermost open element of these names, if no scope stands between."""
        if not any(self._open_names[n] for n in names):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k].name in names:
                self._flush()
                self._cut(k)
                return
            if self._stack[k].name in SCOPE:
                return

    def _close(self, name: str) -> None:
        if not self._open_names[name]:
            if name == "p":
                self._flush()
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k].name == name:
                if name in BLOCKS or any(s.name in BLOCKS for s in self._stack[k:]):
                    self._flush()
                self._cut(k)
                return
            if name not in BLOCKS and self._stack[k].name in BLOCKS:
                return

    def own_text(self) -> dict[int, list[str]]:
        """The texts of the blocks at each path."""
        out: dict[int, list[str]] = defaultdict(list)
        for path, text in self.blocks:
            out[path].append(text)
        return out


class Slot(NamedTuple):
    """A path of a host: what it is, and the text at it over all pages (0 if it is always the same)."""

    path: int
    parent: int
    depth: int
    name: str
    main: bool
    chars: int


def articles(slots: list[Slot]) -> list[tuple[int, int]]:
    """(slot, article's element) of the slots with text, most text first: the nested template's choice of the article.

    From a slot the way leads up: pieces of text to what encloses them, then further as long as little is added, to the
    outermost article or main element at least, and never from another element to the whole body.
    """
    by_path = {s.path: s for s in slots}
    total = {s.path: s.chars for s in slots}
    for s in sorted(slots, key=lambda s: -s.depth):
        if s.parent in total and s.parent != s.path:
            total[s.parent] += total[s.path]
    ranked = sorted((s for s in slots if s.chars), key=lambda s: (-s.chars * (MAIN_WEIGHT if s.main else 1), s.path))
    out = []
    for s in ranked[:SLOTS]:
        here = s
        while here.path and here.parent in by_path:
            up = by_path[here.parent]
            if not (here.name in PIECES or up.main or (up.name not in WHOLE and total[up.path] <= (1 + ADDED) * total[here.path])):
                break
            here = up
        out.append((s.path, here.path))
    return out


def page_slots(page: Page) -> list[Slot]:
    own = page.own_text()
    return [Slot(k, parent, depth, name, main, sum(map(len, own.get(k, ())))) for k, (parent, depth, name, main) in page.paths.items()]


def article_text(page: Page, template: list[tuple[int, int]], fixed: frozenset[int] | set[int]) -> str:
    """The blocks of the article: those under the element that the first slot of the template which the page has leads to,
    without the template's own text. A page without such a slot is a template of its own."""
    if not page.blocks:
        return ""
    region = next((r for s, r in template if s in page.paths and r in page.paths), None)
    if region is None:
        own = articles(page_slots(page))
        region = own[0][1] if own else 0
    inside = {region}
    for path, (parent, _, _, _) in page.paths.items():  # a parent comes before its children
        if parent in inside:
            inside.add(path)
    some = page.blocks if region == 0 else [b for b in page.blocks if b[0] in inside]
    return "\n\n".join(text for path, text in some if not fixed or text_key(path, text) not in fixed)


def text_key(path: int, text: str) -> int:
    return xxh64_intdigest(text, path) >> 1


def page_tokens(page: Page, markup: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of a page's elements (path, parent, depth, name, main, chars, two addends of the vector, body, own text) and of
    its texts (key, two addends, body); bodies are told apart by one bit of 64."""
    mark = xxh64_intdigest(markup)
    one, two = mark & 0xFFFFFF, mark >> 24 & 0xFFFFFF
    body = 1 << (xxh64_intdigest("\0".join(t for _, t in page.blocks)) % 63)
    own = page.own_text()
    elements = []
    for path, (parent, depth, name, main) in page.paths.items():
        n, texts = page.counts[path], own.get(path, ())
        varies = 1 << (xxh64_intdigest("\0".join(texts)) % 63)
        elements.append((path, parent, depth, name, main, sum(map(len, texts)), n * one, n * two, body, varies))
    texts = [(key, n * one, n * two, body) for key, n in Counter(text_key(*b) for b in page.blocks).items()]
    return elements, texts


ELEMENT = "host long, path long, parent long, depth int, name string, main boolean, chars long, one long, two long, body long, varies long"
TEXT = "host long, path long, one long, two long, body long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and texts of pages, in one table: a text has no parent."""
    for batch in batches:
        rows: list[tuple] = []
        for host, markup in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            markup = markup.as_py() or ""
            elements, texts = page_tokens(Page(markup), markup)
            rows += [(host, *e) for e in elements]
            rows += [(host, key, None, None, None, None, None, one, two, body, None) for key, one, two, body in texts]
            if len(rows) >= 20_000:
                yield _table(rows, ELEMENT)
                rows = []
        yield _table(rows, ELEMENT)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            chosen = articles([Slot(**s) for s in row["slots"]])
            blob = pickle.dumps((chosen, frozenset(row["texts"] or ())))
            yield pa.RecordBatch.from_arrays([pa.array([row["host"]], pa.int64()), pa.array([blob], pa.binary())], ["host", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of ``pages(host, html)``: the chosen slots and the keys of the template's texts, for whole hosts.

    Only sums travel, combined before the shuffle; rare paths are left out, so that a host's template has a bounded size.
    """
    tokens = pages.mapInArrow(_tokens, ELEMENT)
    seen = tokens.groupBy("host", "path").agg(
        *(F.max(c).alias(c) for c in ("parent", "depth", "name", "main")), F.sum("chars").alias("chars"), F.count("*").alias("pages"), F.sum("one").alias("one"), F.sum("two").alias("two"),
        F.bit_count(F.bit_or("body")).alias("bodies"), F.bit_count(F.bit_or("varies")).alias("varied"),
    )
    # a text that only few pages hold is never the template's, and doesn't go any further
    seen = C.materialize(seen.where(f"parent is not null or pages >= {AGREEING_PAGES} and bodies >= {AGREEING_PAGES}"), "page-tokens")
    whole = seen.where("path = 0 and parent = 0").select("host", F.col("pages").alias("host_pages"))
    elements = seen.where("parent is not null").join(whole, "host").where(f"pages * {RARE} >= host_pages")
    texts = seen.where("parent is null").select("host", "path", "pages", "one", "two").join(elements.select("host", "pages", "one", "two").distinct(), ["host", "pages", "one", "two"])
    chars = F.when((F.col("pages") < AGREEING_PAGES) | (F.col("varied") >= AGREEING_PAGES), F.col("chars")).otherwise(0).cast("long")
    slots = elements.groupBy("host").agg(F.collect_list(F.struct("path", "parent", "depth", "name", "main", chars.alias("chars"))).alias("slots"))
    return slots.join(texts.groupBy("host").agg(F.collect_list("path").alias("texts")), "host", "left").mapInArrow(_choose, "host long, template binary")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages without what no article holds."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            blobs = []
            for markup in part.column("html"):
                page = Page(markup.as_py() or "")
                blobs.append(zstandard.compress(pickle.dumps((page.paths, page.blocks))) if page.blocks else None)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("host", "page_id", "url")), pa.array(blobs, pa.binary())], ["host", "page_id", "url", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, chosen = None, ([], frozenset())
        for lo in range(0, batch.num_rows, 256):
            part, texts = batch.slice(lo, 256), []
            for blob, template in zip(part.column("page"), part.column("template"), strict=True):
                template = template.as_py()
                if template != held:
                    held, chosen = template, pickle.loads(template) if template else ([], frozenset())
                page = Page("")
                if blob.is_valid:
                    page.paths, page.blocks = pickle.loads(zstandard.decompress(blob.as_py()))
                texts.append(article_text(page, *chosen))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def equivalence_classes(pages: list[Page]) -> list[set[int]]:
    """Classes of the paths that share their occurrence vector over all pages, for hosts that fit one's hands."""
    classes: dict[tuple, set[int]] = defaultdict(set)
    for path in {p for page in pages for p in page.paths}:
        classes[tuple(page.counts[path] for page in pages)].add(path)
    return list(classes.values())


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html, ...)``.

    Two passes over the pages: one gathers each host's template, the other joins it to the host's pages, where Spark divides
    a host with very many. The result doesn't depend on how the rows are dealt out. A null or empty html has an empty text; a
    null url, or one without a host, is of a host of its own kind; repeated rows are pages each; deeply nested and very long
    pages take time and memory in proportion; an empty table gives no rows; further columns are not used.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    keyed = pages.select(F.xxhash64(F.coalesce(host, F.lit(""))).alias("host"), F.col("page_id").cast("long"), "url", "html")
    found = templates(keyed.select("host", "html"))
    parsed = keyed.mapInArrow(_parsed, "host long, page_id long, url string, page binary")
    joined = parsed.join(found.hint("merge"), "host", "left")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
