"""Templates, slots and the article's own parts."""

import random
from collections import Counter, defaultdict

from tests.llm.test_operators import words_of
from weirflow.llm import html

HEAD = "<html><body><div id=top><a href=/>Home</a></div>"


def one(spark, *texts):
    df = spark.createDataFrame([(k, "https://a.example/", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    return [r.text for r in html.main_text(df).orderBy("page_id").collect()]


def test_parts_of_the_article_stay(spark):
    got = one(
        spark,
        "<body><header>Site</header><article><header><h1>Title</h1></header><p>Text.</p></article><header>late</header></body>",
        '<article><p class="search-results-discussion">One</p><div class="notice-board"><p>Two</p></div></article>',
        '<article><p>a <span class="ad">x <span>y</span> z</span> b</p></article>',
        "<article><p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p></article>",
        '<div class="content with-sidebar"><p>Wide</p></div>',
        '<div id="page" class="comments"><p>All there is</p></div>',
        '<div class="sidebar"><article><p>Held</p></article></div>',
        '<article><p>a</p><div class="comment-list"><p>reader</p></div><div class="comments">r</div><p>b<button>no</button></p></article>',
        "<article><p>a <span class=ad>never closed</p><p>b</p></article>",
    )
    assert got == ["Title\nText.", "One\nTwo", "a b", "It is x=2 here", "Wide", "All there is", "Held", "a\nb", "a\nb"]


def test_very_long_and_deep_pages(spark):
    got = one(spark, "<div>" * 20_000 + "x" + "</div>" * 20_000, "<article>" + "<p>word word</p>" * 20_000 + "</article>", "<" * 5000, "</p>" * 5000 + "y")
    assert got[0] == "x" and got[1].count("\n") == 19_999 and got[3] == "y"


def pages(rng, n):
    """A site without <article>: its template must tell what the article is."""
    out = []
    for k in range(n):
        body = "".join(f"<p>{words_of(rng, rng.randrange(20, 60), 5000)}</p>" for _ in range(rng.randrange(1, 6)))
        some = f"<div class=related-posts><p>{words_of(rng, 5, 5000)}</p></div>" if k % 3 == 0 else ""
        out.append(f"{HEAD}<div class=text><h2>{words_of(rng, 4, 5000)}</h2>{body}{some}<div class=letter>Sign up for our letter today</div></div><div class=links><ul><li><a href=/{k}>{words_of(rng, 3, 5000)}</a></li></ul></div></body></html>")
    return out


def test_template_against_plain(spark):
    rng = random.Random(61)
    texts = pages(rng, 20)
    df = spark.createDataFrame([(k, "https://b.example/x", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    found = html.templates(df).first()
    # by hand: tokens with equal occurrence vectors, once on each of at least half of the pages, two of them at least
    counts = [Counter(e.path for e in html.parse(t)[0][1:]) for t in texts]
    vectors = {p: tuple(c[p] for c in counts) for p in set().union(*counts)}
    classes = defaultdict(list)
    for p, v in vectors.items():
        if max(v) == 1 and sum(v) >= 10:
            classes[v].append(p)
    template = sorted(p for c in classes.values() if len(c) > 1 for p in c)
    assert [s.path for s in found.slots] == template
    for s in found.slots:
        around = [p for p in template if s.path.startswith(p + "/")]
        assert s.parent == (max(around, key=len) if around else None)
    assert len({s["class"] for s in found.slots}) == sum(len(c) > 1 for c in classes.values())
    assert found.root == "/html/body/div.text"
    assert {x.path for x in found.texts} == {"/html/body/div.text/div.letter", "/html/body/div.top"}


def test_slots_decide_what_the_article_is(spark):
    rng = random.Random(62)
    texts = pages(rng, 20)
    df = spark.createDataFrame([(k, "https://b.example/x", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    for k, t in enumerate(texts):
        elements, blocks = html.parse(t)
        want = [x for j, x, _ in blocks if "div.text" in elements[j].path and "div.letter" not in elements[j].path and "related-posts" not in elements[j].path]
        assert got[k].split("\n") == want


def test_pages_that_repeat_each_other_keep_their_text(spark):
    page = f"{HEAD}<div class=text><p>The same article on every page of this host, long enough.</p></div><div class=links><p>foot</p></div></body></html>"
    assert set(one(spark, *[page] * 6)) == {"The same article on every page of this host, long enough."}
    assert one(spark) == []
