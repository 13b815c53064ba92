"""Main text of web pages by equivalence classes of tokens.

A page's tokens are the paths of its elements (names with classes and ids) and the texts that stand directly in them.
Over the pages of a host, tokens with one occurrence vector (the same count on the same pages) form a class; vectors are
compared by an order-free fingerprint that Spark sums up per (host, token) with partial aggregates, so that no host is
gathered in one task. A class is valid if its tokens occur once on each of at least ``support`` of the host's pages and
it has two tokens at least. Valid classes, nested by path, are the template. Text falls into slots: the slot of a block is
the innermost template token around it. Text that is the same on most pages is the template's own and fills no slot.

The article's slots are those inside the template's <article> or <main> with most text, or else inside the innermost
token that holds most of the host's running text, without slots whose token is furniture (menus, page headers, footers,
sidebars, notices, adverts, forms, reader comments) on most of its pages. Elements that no template token stands for are
part of the slot around them, unless their name or a class says that they are furniture: a whole word, or, for elements
that hold blocks, the first or last part of one. On pages without a template the same rules choose among the page's own
elements.

Nothing is furniture that holds an <article> or <main>, nor, where all text of a page would go, because of a class word.
A <header> inside the article is part of it. Scripts, styles and pictures break no block.

Null and empty pages give an empty text. A null or odd url counts as the host ''. Repeated pages are extracted alike. No
rows: no rows. Elements nested deeper than 64 share the token of the one around them; their text stays.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import _col, arrow_map, shuffled, slices, written

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
HINT = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Element names. RAW: all up to the end tag is no text.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas", "audio", "video", "xmp", "noembed", "noframes", "annotation", "annotation-xml"}
LEFT_OUT = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "head", "title", "fieldset", "search"}
CONTROL = {"button", "select", "datalist"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "output", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
MATHS = {"math", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
TITLES = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header"}
#: Elements that hold blocks; only their classes are taken apart.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "center", "details"}
#: An open element of the first kind is closed by one of the others.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Classes, ids and roles of what isn't the article.
NOT_ARTICLE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "outbrain", "pagination", "pager", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "widget", "contentinfo", "complementary", "alert", "dialog", "alertdialog",
}
#: Words that say it also at the start of a longer class, and words that turn its meaning round.
FIRST = {"ad", "ads", "advert", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "footer", "gdpr", "menu", "nav", "navbar", "navigation", "newsletter", "pagination", "promo", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe"}
WITHOUT = {"with", "without", "no", "has", "have", "not", "hide", "show", "is"}
DEEPEST = 64


class Element:
    __slots__ = ("name", "path", "parent", "out", "within", "holds", "chars", "links")

    def __init__(self, name: str, path: str, parent: int, out: bool, within: bool):
        #: out: furniture. within, holds: an article.
        self.name, self.path, self.parent, self.out, self.chars, self.links = name, path, parent, out, 0, 0
        self.holds = name in ("article", "main")
        self.within = within or self.holds


def parse(html: str) -> tuple[list[Element], list[tuple[int, str, int]]]:
    """Elements in the order of their start tags, the page itself first; blocks as (innermost element, text, characters in links)."""
    elements, found, stack = [Element("", "", -1, False, False)], [], [0]
    open_: Counter = Counter()
    text: list[str] = []
    link, linked, at, size = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                found.append((stack[-1], block, min(linked, len(block))))
        linked = 0

    def pop() -> None:
        nonlocal last
        last = stack.pop()
        open_[elements[last].name] -= 1

    last = 0
    while at < size:
        lt = html.find("<", at)
        m = TAG.match(html, lt) if lt >= 0 else None
        if m is None:
            end = size if lt < 0 else lt + 1  # a < that opens nothing is text
            text.append(html[at:end])
            linked += (end - at) * bool(link)
            at = end
            continue
        if lt > at:
            text.append(html[at:lt])
            linked += (lt - at) * bool(link)
        at = m.end()
        if m[2] is None:
            continue
        name, closing, rest = m[2].lower(), bool(m[1]), m[3] or ""
        if name in RAW:
            if not closing and not rest.endswith("/"):
                at = _raw_end(html, name, at)
            continue
        if name in INLINE or name in MATHS or name in CONTROL:
            if name == "a":
                link = 0 if closing else 1
            elif name == "br":
                text.append(" ")
            if closing or name in VOID or rest.endswith("/"):
                continue
            if name in CONTROL or rest and furniture(name, rest, True):
                at = _inline_end(html, name, at, open_)
                link = 0 if name == "a" else link
            continue
        flush()
        link = 0
        if closing:
            while open_[name]:
                pop()
                if elements[last].name == name:
                    break
            continue
        if name in VOID:
            continue
        shut = CLOSES.get(name, {"p"} if name not in ("body", "html") else set())
        while len(stack) > 1 and elements[stack[-1]].name in shut:
            pop()
        top = elements[stack[-1]]
        path = f"{top.path}/{name}" + "".join(f".{h}" for h in _hints(rest)) if len(stack) <= DEEPEST else top.path
        stack.append(len(elements))
        open_[name] += 1
        elements.append(Element(name, path, stack[-2], furniture(name, rest, top.within), top.within))
        if rest.endswith("/"):
            pop()
    flush()
    for e in reversed(elements[1:]):
        if e.holds:
            elements[e.parent].holds = True
    return elements, found


def _raw_end(html: str, name: str, at: int) -> int:
    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
    return close.end() if close else len(html)


def _inline_end(html: str, name: str, at: int, around: Counter) -> int:
    """Where an inline element ends whose text is left out: at its own end tag, or where a block around it ends or the page."""
    depth, inner = 1, []
    for m in TAG.finditer(html, at):
        if m[2] is None or m.start() < at:
            continue
        tag, closing, empty = m[2].lower(), bool(m[1]), (m[3] or "").endswith("/")
        if tag == name:
            depth += -1 if closing else 0 if empty else 1
            if not depth:
                return m.end()
        elif tag in RAW and not closing and not empty:
            at = _raw_end(html, tag, m.end())
        elif tag not in INLINE and tag not in VOID and tag not in MATHS and tag not in CONTROL:
            if not closing:
                inner.append(tag)
            elif tag in inner:
                del inner[len(inner) - 1 - inner[::-1].index(tag) :]
            elif around[tag]:
                return m.start()
    return len(html)


def _hints(attributes: str) -> list[str]:
    if not attributes:
        return []
    found = {}
    for m in HINT.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return sorted({re.sub(r"\d+", "0", w.lower()) for k in ("class", "id", "role") for w in found.get(k, "").split()})


def furniture(name: str, attributes: str, in_article: bool) -> bool:
    """By name, by being hidden, by a whole word of class, id or role, or by the first or last part of one."""
    if name in LEFT_OUT and not (name == "header" and in_article):
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for m in HINT.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id", "role"):
            for word in value.split():
                parts = [p for p in re.split(r"[^a-z]+", word) if p]
                if word in NOT_ARTICLE or name in CONTAINERS and len(parts) > 1 and parts[0] not in WITHOUT and (parts[0] in FIRST or parts[-1] in NOT_ARTICLE):
                    if not (in_article and parts[-1] == "header"):
                        return True
    return False


def left_out(elements: list[Element], blocks: list, slots: frozenset = frozenset()) -> list[bool]:
    """Which elements are furniture or inside it. ``slots``: the template's furniture."""

    def chain(by_class: bool) -> list[bool]:
        out = []
        for e in elements:
            is_it = (e.out or e.path in slots) and not e.holds and (by_class or e.name in LEFT_OUT)
            out.append(is_it or e.parent >= 0 and out[e.parent])
        return out

    out = chain(True)
    if blocks and all(out[k] for k, _, _ in blocks):
        out = chain(False)
    return out


def inside(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/") or top == ""


def own_texts(elements: list[Element], blocks: list) -> dict[int, int]:
    """A hash of the text that stands directly in each element that has some."""
    texts: dict[int, list[str]] = {}
    for k, t, _ in blocks:
        texts.setdefault(k, []).append(t)
    return {k: xxhash.xxh64_intdigest("\n".join(ts)) >> 1 for k, ts in texts.items()}


def shares(html: str | None) -> dict[str, list]:
    """Of each path of a page: how often it opens, characters of text inside it, of links among them, whether it is furniture, a hash of its own text."""
    elements, blocks = parse(html or "")
    out = left_out(elements, blocks)
    same = own_texts(elements, blocks)
    for k, t, links in blocks:
        if not out[k]:
            elements[k].chars += len(t)
            elements[k].links += links
    for e in reversed(elements[1:]):
        elements[e.parent].chars += e.chars
        elements[e.parent].links += e.links
    made: dict[str, list] = {}
    for k, e in enumerate(elements):
        # elements nested too deeply share a path with the one around them, which counts for them
        if k and e.path != elements[e.parent].path:
            row = made.setdefault(e.path, [0, 0, 0, False, 0])
            row[0] += 1
            row[1] += e.chars
            row[2] += e.links
            row[3] = row[3] or out[k]
            row[4] ^= same.get(k, 0)
    return made


def rank(path: str, text: float, links: float, whole: float) -> float:
    """How well an element suits as the article's; negative: not at all. Also the rule for single pages."""
    name = re.split(r"[./]", path.rpartition("/")[2])[0]
    if text <= 0:
        return -1.0
    if name in ("article", "main"):
        return 2.0 + text / (whole + 1.0)
    depth = path.count("/")
    return 1.0 + depth / 1000 if text - links >= 0.7 * whole else -1.0


def best(paths: dict[str, list]) -> str | None:
    fit = {p: v for p, v in paths.items() if not v[3] and v[0] == 1} or {p: v for p, v in paths.items() if not v[3]}
    whole = max((v[1] for v in fit.values()), default=0)
    ranked = {p: rank(p, v[1], v[2], whole) for p, v in fit.items()}
    if not ranked or max(ranked.values()) < 0:
        return None
    return min(ranked, key=lambda p: (-ranked[p], p))


@lru_cache(maxsize=64)
def _slots(template: str) -> tuple[str, frozenset, frozenset]:
    """Of a template: the article's root, the furniture among its tokens, and (path, hash) of its own texts."""
    t = json.loads(template)
    return t["root"], frozenset(t.get("furniture") or ()), frozenset((s["path"], s["own"]) for s in t.get("texts") or ())


def article(html: str | None, template: str | None) -> str:
    """The blocks in the article's slots of the template, or of the page alone where it has no such element."""
    elements, blocks = parse(html or "")
    root, slots, texts = _slots(template) if template else (None, frozenset(), frozenset())
    if root is None or not any(e.path == root for e in elements[1:]):
        root, slots, texts = best(shares(html)), frozenset(), frozenset()
    out = left_out(elements, blocks, slots)
    kept = [(k, t) for k, t, _ in blocks if not out[k] and (root is None or inside(elements[k].path, root))]
    if texts:
        same = own_texts(elements, blocks)
        own = [(k, t) for k, t in kept if (elements[k].path, same[k]) not in texts]
        # where most of the article would go, pages of this host repeat each other, and the text isn't the template's
        if 2 * sum(len(t) for _, t in own) >= sum(len(t) for _, t in kept):
            kept = own
    return "\n".join(t for _, t in kept)


def templates(pages: DataFrame, url: str = "url", html: str = "html", support: float = 0.5, least_pages: int = 3) -> DataFrame:
    """One row per host that has a template.

    host, root (the article's token), slots (the template in nested order: path, class, parent, chars of running text,
    furniture), texts (path and hash of texts of the template's own).
    """
    arrow = pa.schema([("host", pa.string()), ("page", pa.int64()), ("path", pa.string()), ("n", pa.int32()), ("chars", pa.int64()), ("links", pa.int64()), ("out", pa.bool_()), ("own", pa.int64())])

    def tokens(batches):
        for batch in batches:
            for b in slices(batch, [2]):
                rows: list[list] = [[] for _ in arrow]
                for host, page, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                    for path, values in shares(text).items():
                        for column, v in zip(rows, (host, page, path, *values)):
                            column.append(v)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

    source = pages.select(host_of(_col(pages, url)).alias("host"), F.xxhash64(_col(pages, url), _col(pages, html)).alias("page"), _col(pages, html).alias("html"))
    found = source.mapInArrow(tokens, "host string, page long, path string, n int, chars long, links long, out boolean, own long")
    # a token's own texts first: one row per text, each page in one of them
    per_text = found.groupBy("host", "path", "own").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.count_if("out").alias("outs")
    )
    per_token = per_text.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.max("most").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), (2 * F.sum("outs") > F.sum("pages")).alias("out"), F.max(F.struct("pages", "own")).alias("text")
    )
    per_token = written(per_token, "page-tokens")
    # every page has the path of its outermost element, so the most frequent token tells how many pages a host has
    hosts = per_token.groupBy("host").agg(F.max("pages").alias("all_pages"), F.max(F.when(~F.col("out"), F.col("chars"))).alias("whole"))
    frequent = per_token.join(hosts, "host").filter((F.col("pages") >= least_pages) & (F.col("pages") >= support * F.col("all_pages")) & (F.col("most") == 1))
    name = F.regexp_extract("path", r"/([^/.]*)[^/]*$", 1)
    constant = (F.col("text.own") != 0) & (F.col("text.pages") >= least_pages) & (F.col("text.pages") >= support * F.col("all_pages")) & ~name.isin(*sorted(TITLES))
    token = F.struct("path", "vector", "chars", "links", "out", "whole", F.when(constant, F.col("text.own")).alias("own"))
    classes = frequent.groupBy("host", "pages", "vector").agg(F.collect_list(token).alias("tokens")).filter("size(tokens) > 1")
    token = classes.select("host", F.explode("tokens").alias("t")).select("host", "t.*")
    depth = F.size(F.split("path", "/")) - 1
    suits = (
        F.when(F.col("out") | (F.col("chars") <= 0), -1.0)
        .when(name.isin("article", "main"), 2.0 + F.col("chars") / (F.col("whole") + 1.0))
        .when(F.col("chars") - F.col("links") >= 0.7 * F.col("whole"), 1.0 + depth / 1000)
        .otherwise(-1.0)
    )
    ranked = token.withColumn("suits", suits).groupBy("host").agg(
        F.max_by("path", F.struct("suits", F.col("path"))).alias("root"),
        F.max("suits").alias("suits"),
        F.sort_array(F.collect_list(F.struct("path", F.col("vector").alias("class"), "chars", F.col("out").alias("furniture")))).alias("t"),
        F.sort_array(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("path", "own")))).alias("texts"),
    )
    # a token's parent is the innermost other token around it
    around = lambda x: F.filter("t", lambda y: F.startswith(x["path"], F.concat(y["path"], F.lit("/"))))
    slots = F.transform("t", lambda x: F.struct(x["path"].alias("path"), x["class"].alias("class"), F.try_element_at(around(x), F.lit(-1))["path"].alias("parent"), x["chars"].alias("chars"), x["furniture"].alias("furniture")))
    return ranked.filter("suits > 0").select("host", "root", slots.alias("slots"), "texts")


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: A host with so large a share of all pages is dealt into so many parts; at most 1 / HOT hosts are.
HOT, PARTS = 0.001, 64


def main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every page, taken from the article's slots of its host's template."""
    keep = pages.columns if keep is None else keep
    furniture_of = F.transform(F.filter("slots", lambda s: s["furniture"]), lambda s: s["path"])
    found = templates(pages, url, html).select(F.col("host").alias("__host"), F.to_json(F.struct("root", furniture_of.alias("furniture"), "texts")).alias("__template"))
    # the pages of a hot host meet its template in many tasks; the list of such hosts is short by what makes a host hot
    hosts = written(pages.groupBy(host_of(_col(pages, url)).alias("hot")).agg(F.count("*").alias("n")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(hosts.filter(F.col("n") >= HOT * total).select("hot", F.lit(PARTS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    found = written(found.join(hot, F.col("__host") == F.col("hot"), "left").select("__host", "__template", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part")), "templates")
    # by position, so that no name of the input clashes
    named = pages.select(*[_col(pages, c).alias(f"c{i}") for i, c in enumerate(keep)], _col(pages, html).alias("html"), host_of(_col(pages, url)).alias("of"))
    dealt = named.join(hot, F.col("of") == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("html", *[f"c{i}" for i, c in enumerate(keep) if named.schema[f"c{i}"].dataType.typeName() in ("string", "long", "integer")]), parts).cast("int"))
    joined = dealt.join(shuffled(found), (F.col("of") == F.col("__host")) & (F.col("part") == F.col("__part")), "left")

    def extract(texts, chosen):
        out = [article(t, c) for t, c in zip(texts, chosen)]
        return out, [len(t) for t in out]

    made = arrow_map(joined, ["html", "__template"], extract, "text string, n_chars long", [f"c{i}" for i in range(len(keep))])
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in ("text", "n_chars")], "text", "n_chars")
