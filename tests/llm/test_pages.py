"""Template deduction and extraction."""

import collections
import time

import pytest

from tallyplan.llm import html_text as H

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><!-- ad --><div class="ad">Buy {n}</div>'
    '<article><h1>Head &amp; {n}</h1><p><b>First {n}<br>line.<p>Second&nbsp;  {n}</p><div class="comments"><p>Reader {n}</p></div></article>'
    '<aside>Side {n}</aside><form>Your mail <input name=q></form><footer>&copy; {n}</footer></body></html>'
)
# without article or main, with the same notice and heading on each page
PLAIN = (
    "<html><body><div class=top>Welcome {n} to it</div><div class=wrap><h2>Title {n}</h2><p>{x}</p><blockquote>Said {n}</blockquote><p>Read the terms.</p><ul><li>one {n}<li>two {n}</ul></div>"
    "<div class=sidebar>x {n}</div></body></html>"
)


def extract(markups):
    """A plain model for the pages of one host: vectors are lists over its pages."""
    pages = [H.Page(m) for m in markups]
    slots, vectors = [], {}
    for path in {p for page in pages for p in page.paths}:
        vectors[path] = tuple(page.counts[path] for page in pages)
        parent, depth, name, main = next(p.paths[path] for p in pages if path in p.paths)
        texts = [tuple(page.own_text().get(path, ())) for page in pages if path in page.paths]
        same = len(texts) >= H.AGREEING_PAGES and len(set(texts)) < H.AGREEING_PAGES
        if len(texts) * H.RARE >= len(pages):
            slots.append(H.Slot(path, parent, depth, name, main, 0 if same else sum(len(t) for x in texts for t in x)))
    seen = collections.defaultdict(lambda: [0] * len(pages))
    for k, page in enumerate(pages):
        for b in page.blocks:
            seen[H.text_key(*b)][k] += 1
    fixed = set()
    for key, vector in seen.items():
        bodies = {tuple(pages[k].blocks) for k, n in enumerate(vector) if n}
        if len(bodies) >= H.AGREEING_PAGES and tuple(vector) in {vectors[s.path] for s in slots}:
            fixed.add(key)
    return [H.article_text(page, H.articles(slots), fixed) for page in pages]


def spark_texts(spark, rows, partitions=1):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(partitions)
    return [r.text for r in sorted(H.html_text(df).collect(), key=lambda r: r.page_id)]


def test_article(spark):
    rows = [("http://a.example/" + str(k), PAGE.format(n=k)) for k in range(4)]
    assert spark_texts(spark, rows)[2] == "Head & 2\n\nFirst 2 line.\n\nSecond 2"
    assert spark_texts(spark, rows[:1]) == ["Head & 0\n\nFirst 0 line.\n\nSecond 0"]


def test_template_without_article():
    texts = extract([PLAIN.format(n=k, x=f"Word{k} " * 30) for k in range(30)])
    assert texts[3] == "Title 3\n\n" + ("Word3 " * 30).strip() + "\n\nSaid 3\n\none 3\n\ntwo 3"
    # one page is no template: its notice stays
    assert extract([PLAIN.format(n=3, x="Word3 " * 30)])[0] == texts[3].replace("\n\none", "\n\nRead the terms.\n\none")


def test_classes_decide(spark):
    """Without the classes of its host every page keeps the notice, and one without a long paragraph takes another element."""
    rows = [("http://a.example/", PLAIN.format(n=k, x=f"Word{k} " * 30 if k % 3 else "")) for k in range(30)]
    whole = spark_texts(spark, rows)
    alone = [H.article_text(H.Page(m), [], set()) for _, m in rows]
    assert all("terms" not in t and "Welcome" not in t and f"Title {k}\n" in t for k, t in enumerate(whole))
    assert sum(a != b for a, b in zip(whole, alone)) == 30


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitions_do_not_matter(spark, partitions):
    equal = "<html><body><article><p>The same on each page.</p><p>Only here {n}.</p></article></body></html>"
    rows = [("http://a.example/", equal.format(n=k)) for k in range(24)] + [("http://b.example/", PLAIN.format(n=k, x=f"Text {k} " * 9)) for k in range(70)] + [("http://c.example/", PAGE.format(n=k)) for k in range(3)]
    expected = extract([h for _, h in rows[:24]]) + extract([h for _, h in rows[24:94]]) + extract([h for _, h in rows[94:]])
    spark.conf.set("spark.sql.adaptive.enabled", partitions != 4)
    try:
        assert spark_texts(spark, rows, partitions) == expected
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert expected[0] == "Only here 0."  # shared by all of the host: the template's


def test_equal_texts_of_some_pages_stay(spark):
    rows = [("http://a.example/", f"<html><body><article><p>A shared line.</p><p>Own {k}.</p></article></body></html>") for k in range(12)]
    rows += [("http://a.example/", f"<html><body><article><p>Own {k}.</p><p>And {k}.</p></article></body></html>") for k in range(12, 24)]
    assert spark_texts(spark, rows)[3] == "A shared line.\n\nOwn 3."


def test_copies_of_a_page_are_no_template(spark):
    assert set(spark_texts(spark, [("http://a.example/", PAGE.format(n=1))] * 40)) == {"Head & 1\n\nFirst 1 line.\n\nSecond 1"}


def test_classes_share_their_vector():
    pages = [H.Page("<html><body><main><h1>a</h1><p>x</p><p>y</p></main></body></html>"), H.Page("<html><body><main><h1>a</h1></main></body></html>")]
    sizes = sorted(len(c) for c in H.equivalence_classes(pages))
    assert sizes == [1, 5]  # the paragraphs; and page, html, body, main, h1


def test_broken_markup():
    for text in ("", "<", "<p", "<p>a<p>b</div></x>", "a & b &lt; c <b>d", "<script>x", "<article>a<ul><li>b<li>c</article>d", "<!--", "<a href='x>y'>z</a>"):
        extract([text])
    assert extract(["<article>a<ul><li>b<li>c</ul></article>d"]) == ["a\n\nb\n\nc"]


@pytest.mark.parametrize("piece", ["<div>", "<div><p>x", "<b>", "</b>", "<b><p>", "<li>a", "<table><tr><td>", "<!--", "<script>", "&amp", "<a b='"])
def test_hostile_pages_take_linear_time(piece):
    took = []
    for n in (5_000, 50_000):
        began = time.process_time()
        page = H.Page("<div>" + piece * n + "end")
        H.article_text(page, [], set())
        took.append(time.process_time() - began)
    assert took[1] < 60 * took[0] + 1


def test_a_long_page_is_whole(spark):
    texts = [f"paragraph {k} " + "w" * 200 for k in range(20_000)]
    assert spark_texts(spark, [("http://a.example/", "<main>" + "".join(f"<p>{t}</p>" for t in texts) + "</main>")]) == ["\n\n".join(texts)]


def test_rows(spark):
    rows = [(1, "http://h.example/a", PAGE.format(n=1), 1), (1, "http://h.example/a", PAGE.format(n=1), 1), (2, None, None, 1), (3, "nohost", "", 1), (None, "http://h.example/b", "plain", 1)]
    got = H.html_text(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and {r.text for r in got if r.page_id is None} == {"plain"}
    assert H.html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("element", "attribute", "value", "aside"),
    [
        ("h2", "id", "search-algorithms", False), ("p", "class", "alert-fatigue", False), ("section", "id", "related-work", False), ("table", "class", "menu-engineering", False), ("div", "class", "social-science post", False),
        ("h2", "id", "comments", False), ("div", "id", "comments", True), ("div", "class", "post related-posts", True), ("div", "class", "site-footer", True), ("div", "class", "cookie-notice", True), ("div", "class", "ad", True),
        ("div", "class", "page-footer", True), ("div", "role", "complementary", True), ("div", "class", "adventure", False), ("ul", "class", "share_buttons", True), ("div", "class", "", False),
    ],
)
def test_names_of_subjects_are_no_names_of_asides(element, attribute, value, aside):
    assert H.names_aside(element, attribute, value) == aside


def test_articles_keep_what_is_named_after_its_subject(spark):
    kept = '<h2 id="search-algorithms">Search</h2><p class="alert-fatigue">Alerts tire.</p><section id="related-work"><p>Others did.</p></section><table class="menu-engineering"><tr><td>Menus</td></tr></table>'
    gone = '<div class="related-posts"><p>More</p></div><div class="comment-list"><p>First!</p></div><div class="cookie-banner">Cookies</div>'
    pages = [("http://a.org/1", f"<html><body><article>{kept}{gone}</article></body></html>"), ("http://b.org/1", '<html><body><div class="social-science post"><p>Of people.</p></div></body></html>')]
    assert spark_texts(spark, pages) == ["Search\n\nAlerts tire.\n\nOthers did.\n\nMenus", "Of people."]
