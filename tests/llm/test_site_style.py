import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest_llm import multiset
from tarn.llm import site_style as st

SCHEMA = "page_id long, url string, html string, host string, text string, low string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa river stone light water house tree garden winter summer".split()


def prose(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + f" {rng.random()}."


def site(n, seed, host="a.example.com"):
    """Pages without semantic elements: a menu, a box of house news and a legal line on every page, and a text of their own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [prose(rng) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in own)
        html = f'<html><body><div class="top1"><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div><div class="col2"><h3>House news</h3><p>Our shop is open all day.</p></div><div class="text"><h1>Title {i}</h1>{body}</div><div class="end">All rights are ours.</div></body></html>'
        rows.append((i, f"http://{host}/{i}", html, "\n".join([f"Title {i}", *own])))
    return rows


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, u, h, *_ in rows], SCHEMA).repartition(3)


def test_what_a_site_repeats_goes(spark):
    rows = site(40, 1) + site(60, 2, "b.example.com")
    got = {(r["url"]): (r["text"], r["n_chars"]) for r in st.extract(pages(spark, rows)).collect()}
    assert got == {u: (t, len(t)) for _, u, _, t in rows}


def test_few_pages_keep_all(spark):
    """Of a site with two pages nothing is known to repeat; a URL without a host has no site."""
    rows = site(2, 3)
    assert all("House news" in r["text"] for r in st.extract(pages(spark, rows)).collect())
    none = [(i, None if i % 2 else "no url", h, t) for i, _, h, t in site(30, 3)]
    assert all("House news" in r["text"] for r in st.extract(pages(spark, none)).collect())


def test_copies_do_not_lose_their_text(spark):
    """Near copies in large number on one site: everything repeats there, but main parts keep their prose."""
    rng = random.Random(4)
    shared = [prose(rng) for _ in range(5)]
    rows = [(i, f"http://c.example.com/{i}", "<nav>x</nav><article><h1>Same</h1>" + "".join(f"<p>{p}</p>" for p in shared) + (f"<p>{prose(rng)}</p>" if i % 50 == 0 else "") + '<div class="box">Get our letter</div></article>', "") for i in range(100)]
    got = {r["page_id"]: r["text"].split("\n") for r in st.extract(pages(spark, rows)).collect()}
    assert all(t[:6] == ["Same", *shared] and "Get our letter" not in t for t in got.values())
    bare = [(i, u, "<body><div>" + "".join(f"<div>{p}</div>" for p in shared) + "</div></body>", "") for i, u, *_ in rows]
    assert {r["text"] for r in st.extract(pages(spark, bare)).collect()} == {"\n".join(shared)}


def plain_importances(rows):
    """By the definition, with a recursion over each host's merged tree."""
    seen = {}

    def add(e, path, depth):
        own = [c for c in e.children if isinstance(c, st.Element) and not c.out]
        text = " ".join(" ".join(c for c in e.children if isinstance(c, str)).split())
        node = seen.setdefault(path, {"styles": Counter(), "texts": Counter(), "shares": Counter(), "children": set()})
        units = len(own) + bool(text)
        if own or not text:
            node["styles"][tuple(c.name for c in own)] += 1
        if text:
            if own:
                leaf = seen.setdefault((*path, "#text"), {"styles": Counter(), "texts": Counter(), "shares": Counter(), "children": set()})
                leaf["texts"][text] += 1
                node["shares"][*path, "#text"] += st.UNIT // units
                node["children"].add((*path, "#text"))
            else:
                node["texts"][text] += 1
        for c in own:
            below = (*path, c.name)
            node["shares"][below] += st.UNIT // units
            node["children"].add(below)
            add(c, below, depth + 1)

    for html in rows:
        add(st.parse(html), ("",), 0)

    def value(path):
        node, out = seen[path], []
        if node["texts"]:
            m = sum(node["texts"].values())
            out.append(1.0 if m == 1 else 1 - sum(math.log(k) / math.log(m) for k in node["texts"].values()) / len(node["texts"]))
        if node["styles"]:
            m = sum(node["styles"].values())
            own = 1.0 if m == 1 else -sum(k / m * math.log(k / m) for k in node["styles"].values()) / math.log(m)
            if node["children"]:
                total = sum(node["shares"].values())
                inner = sum(node["shares"][c] * value(c) for c in node["children"]) / total
                w = st.DECAY ** len(node["styles"])
                own = (1 - w) * own + w * inner
            out.append(own)
        return max(out)

    return sorted((round(value(p), 6), sum(seen[p]["styles"].values()) + sum(seen[p]["texts"].values())) for p in seen)


def test_importances_equal_the_definition(spark):
    """Branches in which an element has either texts or children, as a row of each kind weighs alone there."""
    rows = site(30, 5) + site(7, 6)
    tree = st.importances(pages(spark, rows).select(F.lit("h").alias("host"), "html"))
    assert sorted((round(r["importance"], 6), r["pages"]) for r in tree.collect()) == plain_importances([h for _, _, h, _ in rows])


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("just text", "just text"), ("a &lt;b&gt; &amp;amp &copy; &#233;&nbsp;x &am", "a <b> &amp © é x &am"), ("<p>one<p>two<b>three<br>four<p>five", "one\ntwothree four\nfive"),
    ("<title>t</title><style>p{}</style><script>var t='</p>'</script><p>a<!-- b --></p>c", "a\nc"), ("<article><h1>T</h1><p>x</article><footer>f</footer>", "T\nx"),
    ("<p>x</p><p class=\"ad\">buy</p><div id='sidebar'>s</div><div class=adverbs>y</div>", "x\ny"), ("<main><header><h1>T</h1></header><p>x</p><aside>a</aside><form>f</form></main>z", "T\nx"),
    ("<header>site</header><article class='post with-sidebar'><p>x</p><section id=comments><article>c</article></section></article>", "x"), ("<article><p>cut off</p><p cla", "cut off"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("1 < 2 <3> </ x", "1 < 2 <3>"), ("<p a='>'>x</p><p b=\"'>y</p>", "x\ny"), ("<p hidden>h</p><p aria-hidden=true>h</p><p style='display: none'>h</p><p>x", "x"),
    ("<SCRIPT>x</SCRIPT ><P>Y</P>", "Y"), ("<script>never ends <p>x", ""), ("a</p>b", "a\nb"), ("<div>a<span> b</span></div>", "a b"), ("<article class=comment>c</article><p>x</p>", "x"), ("<p>a  \n\tb</p>", "a b"),
])
def test_texts(html, text):
    assert st.text_of(html or "") == text


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<p>" * 50_000 + "x", "<p a=\"" * 20_000, "<" * 100_000, "<a b='" + "x" * 500_000, "&" * 100_000, "<li>" * 30_000, "</p>" * 30_000, "<b>" * 30_000 + "</i>" * 3_000, "<!--" * 50_000, "= " * 200_000 + "<p " + "= " * 100_000, "<b>" * 30_000 + "<p>x" * 3_000, "<header>" * 30_000 + "x", "<article class=nav>" * 30_000 + "x"], ids=range(14))
def test_hard_pages_take_linear_time(html):
    began = time.process_time()
    keys = {key for _, key, _ in st._walk(st.parse(html))} - {0}
    st.text_of(html, keys)
    assert time.process_time() - began < 5


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a.example.com/", "<p>x"), (2, "http://a.example.com/", "")]
    assert multiset(st.extract(pages(spark, rows)), "page_id", "text", "n_chars") == sorted([(1, "", 0), (1, "", 0), (None, "x", 1), (2, "", 0)], key=repr)
    assert st.extract(pages(spark, rows).limit(0)).count() == 0


def test_given_pages(spark, sf):
    """The articles of the test pages, cut out by a plain pattern."""
    import html as h

    from tarn.llm.shared import table

    def plain(page):
        inner = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        return "\n".join(b for b in blocks if b)

    given = {r["page_id"]: plain(r["html"]) for r in table(spark, sf, "pages").collect()}
    assert {r["page_id"]: r["text"] for r in st.query(spark, sf).collect()} == given
