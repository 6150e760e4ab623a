"""Operator 12, HTML extraction: a site style tree for every host.

The pages of a host are merged into one tree: an element is the path of names that leads to it, its styles are the
sequences of children that pages give it, its contents are the texts that stand in it. How evenly pages differ there, as an
entropy, is an element's importance; branches of low importance are what the site repeats on its pages, and each page loses
them. What names itself a menu, an advert or the like goes before that, as a site's adverts may differ on every page.

Pages meet their host's removable branches in a join; a tree is never held whole in one place.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import discard, stored, table
from tarn.llm.url_filter import host_of

#: Weight of an element's own entropy against its children's: 1 - DECAY ** number of styles.
DECAY = 0.9
#: A branch goes below this importance, when it stands on so many pages and on this share of the host's.
LOW, FEWEST, SHARE = 0.3, 5, 0.01
#: Elements below this depth belong to their ancestor there; no text is lost by it.
DEPTH = 32
#: Shares of children are summed as integers of this unit, so that sums don't depend on their order.
UNIT = 1 << 20
#: Rows that a task holds before it sends them on.
HELD = 50_000

#: Elements without end tags, elements whose content is no markup, elements that stand for a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: What an element's start tag closes, up to the nearest of the elements that hold it.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "p"})),
}
HOLDS = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), **dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), frozenset({"table"}))}
#: Elements, roles and words of classes and ids that name what isn't a page's text.
NOT_TEXT = frozenset("head title script style noscript template iframe object embed applet svg canvas audio video form button select textarea input datalist nav footer aside dialog menu noembed noframes map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertise advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead topbar footer "
    "sidebar sidebars aside cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies reactions pagination pager skip toolbar copyright disclaimer legal".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
MAIN = frozenset({"article", "main"})

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("children", "in_article", "in_main", "name", "out", "parent", "tag")

    def __init__(self, tag: str, name: str, parent: Element | None, out: bool):
        self.tag, self.name, self.parent, self.out = tag, name, parent, out
        self.in_article = tag == "article" or parent is not None and parent.in_article
        self.in_main = tag in MAIN or name.endswith("@main") or parent is not None and parent.in_main
        self.children: list = []  # elements and texts, in page order


def _named(tag: str, rest: str, inside: Element) -> tuple[str, bool]:
    """The name of an element in its site's tree, and whether it names itself as no part of a page's text."""
    if tag in NOT_TEXT:
        return tag, True
    if "=" not in rest and "hidden" not in rest:
        return tag, tag == "header" and not inside.in_main
    found = {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}
    kind, ident, role = found.get("class", ""), found.get("id", ""), found.get("role", "").lower()
    name = tag + "".join(f".{c}" for c in sorted(set(kind.split())))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return name, True
    words = {w.lower() for w in _WORDS.findall(f"{kind} {ident}")}
    if tag in MAIN or role == "main":
        return f"{name}@main" if role == "main" else name, bool(words & COMMENTS) or tag == "article" and inside.in_article and bool(words & NAMES)
    if tag in ("html", "body"):
        return name, False
    if tag == "header" or "header" in words:
        return name, not inside.in_main
    return name, role in ROLES or bool(words & NAMES)


def _up(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def parse(page: str) -> Element:
    """The page's elements. Tags that are left open end where the elements around them do; one that is cut off is dropped,
    and a quote that never closes ends with its tag."""
    at = root = Element("", "", None, False)
    begin, n = 0, len(page)
    opened: Counter = Counter()  # tags of the elements that are open: none is looked for that isn't there

    def closed(inner: Element, outer: Element) -> Element:
        """What is open once ``outer`` and all that is open within it are closed."""
        while inner is not outer.parent:
            opened[inner.tag] -= 1
            inner = inner.parent
        return inner
    while begin < n:
        lt = page.find("<", begin)
        if lt < 0:
            lt = n
        if lt > begin:
            at.children.append(references.unescape(page[begin:lt]))
        if lt >= n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if page.startswith(("<!-->", "<!--->"), lt):
                end = page.find("-->", lt + 2)
            begin = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt) or page.startswith("</", lt) and not page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            begin = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2].isalpha() or page.startswith("</", lt):  # cut off
                break
            at.children.append("<")
            begin = lt + 1
            continue
        begin, tag = m.end(), m[2].lower()
        if m[1]:
            open_ = at if opened[tag] else root
            while open_ is not root and open_.tag != tag:
                open_ = None if open_.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") and tag not in BLOCKS else open_.parent
                if open_ is None:
                    break
            if open_ is not None and open_ is not root:
                at = closed(at, open_)
            elif tag == "p":  # stands for an empty paragraph
                at.children.append(Element("p", "p", at, at.out))
            continue
        if closes := CLOSES.get(tag):
            holds, open_, close, left = HOLDS.get(tag, frozenset()), at, None, sum(opened[t] for t in closes)
            while left and open_ is not root and open_.tag not in holds and (holds or open_.tag not in BLOCKS or open_.tag in closes):
                if open_.tag in closes:
                    close, left = open_, left - 1
                open_ = open_.parent
            if close is not None:
                at = closed(at, close)
        name, out = _named(tag, m[3], at)
        made = Element(tag, name, at, out or at.out)
        at.children.append(made)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, begin)
            if found is None:
                break
            begin = found.start()
            end = page.find(">", begin)
            begin = n if end < 0 else end + 1
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")):
            at = made
            opened[tag] += 1
    return root


def _digest(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _walk(root: Element) -> Iterator[tuple[Element, int, int]]:
    """The elements that don't name themselves as no text, with their keys and depths. The key of an element is its path."""
    todo = [(root, 0, 0)]
    while todo:
        e, key, depth = todo.pop()
        yield e, key, depth
        for c in e.children:
            if isinstance(c, Element) and not c.out:
                todo.append((c, key, depth) if depth >= DEPTH else (c, _digest(str(key), c.name), depth + 1))


_COUNTS = "host string, key long, parent long, depth int, leaf boolean, value long, n long, share long"


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each style and each text of an element occurs in a task's pages; ``share``: of its siblings, summed."""
    seen: Counter = Counter()
    shares: Counter = Counter()

    def sent() -> pd.DataFrame:
        rows = [(*k, n, shares[k]) for k, n in seen.items()]
        seen.clear()
        shares.clear()
        return pd.DataFrame(rows, columns=["host", "key", "parent", "depth", "leaf", "value", "n", "share"])

    for b in batches:
        for host, page in zip(b["host"], b["html"], strict=True):
            part = {0: (0, UNIT)}  # of each key of this page: its parent's key, its share
            for e, key, depth in _walk(parse(page)):
                own = [c for c in e.children if isinstance(c, Element) and not c.out]
                text = " ".join(" ".join(c for c in e.children if isinstance(c, str)).split())
                parent, share = part[key]
                if depth < DEPTH:
                    for c in own:
                        part[_digest(str(key), c.name)] = key, max(1, UNIT // (len(own) + bool(text)))
                if own or not text:
                    k = host, key, parent, depth, False, _digest(*[c.name for c in own])
                    seen[k] += 1
                    shares[k] += share
                if text:  # a leaf of its own where there are children too
                    k = (host, _digest(str(key), "#text"), key, depth + 1, True, _digest(text)) if own else (host, key, parent, depth, True, _digest(text))
                    seen[k] += 1
                    shares[k] += max(1, UNIT // (len(own) + 1)) if own else share
            if len(seen) >= HELD:
                yield sent()
    yield sent()


def importances(pages: DataFrame) -> DataFrame:
    """``host, key, parent, depth, pages, importance, most`` of the elements of every host's tree, from ``pages(host, html)``.

    An element's entropy is that of its styles over the pages that have it, by the logarithm of their number, so from 0 (one
    style) to 1 (all differ). A text that stands on k of m pages has log k / log m; a leaf's importance is 1 less the mean
    over its texts. An element's importance weighs its own entropy against its children's importance, and more towards
    the children the fewer styles it has. What one page alone has is of importance 1. ``most`` is the greatest importance in
    the element's branch.
    """
    raw = pages.where("host <> '' and html is not null").select("host", "html").mapInPandas(counted, _COUNTS)
    counts = stored(raw.groupBy("host", "key", "parent", "depth", "leaf", "value").agg(F.sum("n").alias("n"), F.sum("share").alias("share")))
    logs = F.sum(F.col("n") * F.log("n"))
    own = counts.groupBy("host", "key", "parent", "depth", "leaf").agg(F.sum("n").alias("m"), F.count("*").alias("l"), logs.alias("nlogn"), F.sum(F.log("n")).alias("logn"), F.sum("share").alias("share"))
    log_m = F.log("m")
    styles = F.when(F.col("m") == 1, 1.0).otherwise((log_m - F.col("nlogn") / F.col("m")) / log_m)
    texts = F.when(F.col("m") == 1, 1.0).otherwise(1 - F.col("logn") / log_m / F.col("l"))
    keys = stored(own.withColumn("own", F.when(F.col("leaf"), texts).otherwise(styles)))
    discard(counts)
    deepest = keys.agg(F.max("depth")).first()[0]
    done, below = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = keys.where(F.col("depth") == depth)
        if below is not None:
            inner = below.groupBy("host", F.col("parent").alias("key")).agg((F.sum(F.col("importance") * F.col("share")) / F.sum("share")).alias("inner"), F.max("most").alias("under"))
            level = level.join(inner, ["host", "key"], "left")
        else:
            level = level.withColumn("inner", F.lit(None).cast("double")).withColumn("under", F.lit(None).cast("double"))
        weight = F.pow(F.lit(DECAY), F.col("l"))
        mixed = F.when(F.col("leaf") | F.col("inner").isNull(), F.col("own")).otherwise((1 - weight) * F.col("own") + weight * F.col("inner"))
        below = stored(level.select("host", "key", "parent", "depth", "leaf", F.col("m").alias("pages"), "share", mixed.alias("importance"), F.greatest(mixed, "under").alias("most")))
        done = below if done is None else done.unionByName(below)
    if done is None:
        done = keys.select("host", "key", "parent", "depth", "leaf", F.col("m").alias("pages"), "share", F.col("own").alias("importance"), F.col("own").alias("most"))
    # An element with texts in some pages and children in others has a row of each kind: the more important one counts.
    return done.groupBy("host", "key", "parent", "depth").agg(F.sum("pages").alias("pages"), F.max("importance").alias("importance"), F.max("most").alias("most"))


def removable(tree: DataFrame) -> DataFrame:
    """``host, low``: keys of the branches in which all is of low importance. Each stands on a share of its host's pages, so there are at
    most 1 / SHARE times as many keys for a host as a page of it has elements."""
    of = tree.where("depth = 0").select("host", F.col("pages").alias("all"))
    low = tree.where(F.col("depth") > 0).join(of, "host").where((F.round("most", 6) < LOW) & (F.col("pages") >= FEWEST) & (F.col("pages") >= F.col("all") * SHARE))
    return low.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("low"))


#: Elements of a main part that are its text, whatever the site's other pages say.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead table figcaption caption summary".split())


def _sizes(root: Element) -> dict[int, int]:
    """Characters of text in every element that doesn't name itself as no text, by ``id``."""
    every = [e for e, _, _ in _walk(root)]
    out = {id(e): sum(len(c) - c.count(" ") for c in e.children if isinstance(c, str)) for e in every}
    for e in reversed(every):  # an element comes after the one that holds it
        if e.parent is not None:
            out[id(e.parent)] += out[id(e)]
    return out


def main_parts(root: Element) -> list[Element]:
    """The outermost articles that aren't named otherwise; without any the outermost main elements; else the page."""
    every, mains, todo = [], [], [(root, False, False)]
    while todo:
        e, in_article, in_main = todo.pop()
        article, main = e.tag == "article", e.tag == "main" or e.name.endswith("@main")
        if article and not in_article:
            every.append(e)
        if main and not in_main:
            mains.append(e)
        todo += [(c, in_article or article, in_main or main) for c in reversed(e.children) if isinstance(c, Element) and not c.out]
    return every or mains or [root]


def text_of(page: str, low: set[int] = frozenset()) -> str:
    """The main text of a page of a site with the removable branches ``low``.

    Where a page has articles or a main element, they are its text. Branches in ``low`` go, but for a main part itself, its
    paragraphs, headings, lists and tables, and branches that hold half of its text or more. If nothing were left, the
    branches stay.
    """
    root = parse(page)
    parts = main_parts(root)
    gone: set[int] = set()
    if low:
        inside = {id(x) for p in parts if p is not root for x in _below(p)}
        holders: set[int] = set()
        for p in parts:
            for x in _up(p):
                if id(x) in holders:
                    break
                holders.add(id(x))
        for e, key, _ in _walk(root):
            if key in low and id(e) not in holders and not (id(e) in inside and (e.tag in _PROSE or e.tag not in BLOCKS)):
                gone.add(id(e))
        if gone and inside:
            sizes = _sizes(root)
            whole = sum(sizes[id(p)] for p in parts)
            gone -= {i for i in gone & inside if 2 * sizes[i] >= whole}
    for without in (gone, set()):
        out = _blocks(parts, without)
        if out or not without:
            return "\n".join(out)
    return ""


def _below(e: Element) -> Iterator[Element]:
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in x.children if isinstance(c, Element)]


def _blocks(parts: list[Element], gone: set[int]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for p in parts:
        todo: list = [p]
        while todo:
            c = todo.pop()
            if c is None:
                flush()
            elif isinstance(c, str):
                run.append(c)
            elif not c.out and id(c) not in gone:
                if c.tag == "br":
                    run.append(" ")
                block = c.tag in BLOCKS or c.tag == ""
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(c.children)
        flush()
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    A null or empty page has an empty text. A null URL, or one without a host, has no site: such pages lose only what names
    itself. Repeated rows stay repeated and count as pages of their own; other columns are ignored, whatever their names.
    A host's removable branches are a row of bounded size; Spark broadcasts them when all are measured as small, else pages
    are joined by host, against a written table, so that a host with many pages is split.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    low = stored(removable(importances(own)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [text_of(page, frozenset() if keys is None else set(np.asarray(keys).tolist())) if page else "" for page, keys in zip(b["html"], b["low"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(own.dtypes)["page_id"]
    return own.join(low, "host", "left").select("page_id", "url", "html", "low").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: No SQL parses HTML; the tests hold the tree against a plain version, and texts against pages made with known texts.
SQL = None
