import random
import re
import time
from functools import lru_cache

from pyspark.sql import functions as F

from quillmesh.llm import pages as p


def test_common_subsequence_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))

        @lru_cache(None)
        def best(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(best(i + 1, j), best(i, j + 1), 1 + best(i + 1, j + 1) if a[i] == b[j] else 0)

        got = p.common(a, b)
        assert len(got) == best(0, 0) and got == sorted(set(got))
        rest = iter(b)
        assert all(a[k] in rest for k in got)


def main_text(html):
    found = p.blocks(html)
    want = p.IN_ARTICLE if any(s == p.IN_ARTICLE for s, _ in found) else p.PLAIN
    return "\n".join(t for s, t in found if s == want)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>x";</script></head><body class="post-page">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class=cookie-notice><p>We use cookies</div>
    <div class="ad">Buy</div><article id="a1"><header><h1>The &lt;Title&gt; &eacute;</h1></header><p>One <b>bold</b>,
       two&nbsp;three<br>four<p>Five<aside>Aside</aside><ul><li>Six<li>Seven</ul><form><p>Mail<input></form><script>if (a<b) x();</script>
    <section class="comments"><article class="comment"><p>First!</p></article></section><p>Last</article><div class='sidebar'>Side</div><footer>Foot</footer></body></html>"""
    assert main_text(page) == "The <Title> é\nOne bold, two three four\nFive\nSix\nSeven\nLast"
    assert main_text("no tags &amp; all") == "no tags & all" and main_text(None) == main_text("") == "" == main_text("<p> \n </p><br>")
    assert main_text("<p>a<p>b</div></p>c<!-- open <p>d") == "a\nb\nc" and main_text("a < b <p title='>'>c") == "a < b\nc"
    assert main_text("<article><p>cut off <b>here") == "cut off here"
    assert main_text("<p>" + "x <i>y</i> " * 100_000).count("y") == 100_000


def test_names_are_whole_classes_and_roles():
    """Slugs in ids, headers of articles and notes stay; teasers are no article; landmarks and parts of classes go."""
    page = """<body><div class="site-header">Brand</div><div role=navigation>Links</div><article id="share-menu"><header class="entry-header"><h1>Title</h1></header>
    <h2 id="legal-history">Legal history</h2><p class="side-note" id="footer">Note</p><p class="form-of-words">Words</p><div class="ad-slot">Buy</div><ul class="share-buttons"><li>Like</ul>
    <div class="post-footer">Tags</div><section id="comments-on-law">Law</section><div class="comment-list"><p>First!</p></div><div role="complementary">More</div></article><div class="cookie-notice">Cookies</div></body>"""
    assert main_text(page) == "Title\nLegal history\nNote\nWords\nLaw"
    assert main_text('<div class="post-list">Teaser</div><div class="post">Other</div><div id="content">Real text</div>') == "Teaser\nOther\nReal text"
    assert main_text('<div role="main">Real</div><div class="story">Other</div>') == "Real"
    assert main_text('<main class="search banner"><p>Text</main>') == "Text"
    assert main_text("<p>x</p><header><h1>Site</h1></header>") == "x"


def test_broken_tags():
    assert main_text('<p>a<b title="x > y">b</b> <i alt=\'never ends>c</i>d') == "ab cd"
    assert main_text("<p>one <a href=") == "one" and main_text("<p>one < two <3 </ x>") == "one < two <3 </ x>"
    assert main_text('<p a"b>c</p><p a=b"c>d</p>') == "c\nd"
    assert main_text("<textarea>no <p>x</textarea><p>y<title>t</title>z") == "y\nz" and main_text("<p>a<title>b") == "a"
    assert main_text("<p>a<SCRIPT>x</p></scripty></Script >b<style>z") == "ab"
    assert main_text("<p>a <svg><p>no</svg> <button>no</button>b <select><option>x</select>c</p>d <svg>e") == "a b c\nd"
    assert main_text("<p>a</div></span>b</p></p>c") == "ab\nc" and main_text("<![CDATA[x <b>]]>y<!-- z") == "x <b>y"


def test_parsing_is_linear():
    """Hostile pages of two sizes: four times the page takes no sixteen times the time."""
    pieces = ['<a "', '<a b="', "<a b='x\" ", "<div>", "<title>", "<textarea>x", "<!-- ", "<![CDATA[", "<x", "< ", "&amp", "<script>", "</p", "<p class=", "<p class = ", "</li>", "<b c= "]
    tall = ["<div>" * n + "</x>" * n + "</div>" * n for n in (20_000, 80_000)]
    for small, large in [*((piece * 10_000, piece * 40_000) for piece in pieces), tall]:
        times = []
        for page in (small, large):
            began = time.perf_counter()
            p.blocks(page)
            times.append(time.perf_counter() - began)
        assert times[1] < 9 * times[0] + 0.3, (small[:20], times)


def site(menu, body, foot):
    return f"<html><body>{''.join(f'<div>{m}</div>' for m in menu)}<p>{body}</p><div>{foot}</div></body></html>"


ROWS = [
    (1, "http://h.org/a/1", site(["Home", "News"], "First story", "(c) h")),
    (2, "http://h.org/a/2?x=1", site(["Home", "News"], "Second story", "(c) h")),
    (2, "http://h.org/a/2?x=1", site(["Home", "News"], "Second story", "(c) h")),
    (3, "http://h.org/a/3.html#f", site(["Home", "News", "Own"], "Third story", "(c) h")),
    (4, "http://lone.org/", site(["Home"], "Alone", "(c)")),
    (5, "http://h.org/a/4", "<article><p>First story</p></article>"),
    (6, None, None),
    (None, "", ""),
    (7, "http://h.org/b/9", "<div>Home</div><p>Fourth"),
]
WANT = {1: "First story", 2: "Second story", 3: "Own\nThird story", 4: "Home\nAlone\n(c)", 5: "First story", 6: "", None: "", 7: "Home\nFourth"}


def test_extract(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = p.extract(pages).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.text == WANT[r.page_id] and r.n_chars == len(r.text), r
    assert sorted(map(str, p.extract(pages.repartition(7)).collect())) == sorted(map(str, got))
    assert p.extract(pages.where("false")).count() == 0


def test_large_host_pairs_as_a_whole(spark):
    """A host of more pages than were once split by first letter, over several ranges: pairs as in one sorted list."""
    rows = [(i, f"http://big.org/{'abcdefghij'[i % 10]}{i // 300}/{i:05d}", site(["Home"] + [f"In {i // 7}"], f"Story {i}", "(c)")) for i in range(2300)]
    rows += [(i, f"http://big.org/zz?{i}", site(["Home"], f"Story {i}", "(c)")) for i in range(2300, 2340)]
    rows += [(5000 + i, f"http://h{i}.org/{k}", site(["Top"], f"Small {i} {k}", "(c)")) for i in range(30) for k in range(i % 3 + 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = sorted((p.Page((host, path), (i, url), [s for s, _ in found], [t for _, t in found], [t for _, t in found]) for i, url, page in rows for host, path in [p.place(url)] for found in [p.blocks(page)]), key=lambda x: (x.key, x.row[1], x.row[0]))
    want = sorted((*page.row, *page.text(mate)) for page, mate in p.paired(iter(made)))
    got = sorted((r.page_id, r.url, r.text, r.n_blocks, r.n_shared) for r in p.extract(pages).collect())
    assert got == want
    assert p.extract(pages).rdd.getNumPartitions() > 1


def test_pages_without_an_article(spark):
    """The test table with its articles as plain divisions, and menus that a host repeats: differencing decides."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    whole = re.compile("<article>(.*)</article>", re.S)
    truth, made = {}, []
    for r in rows:
        host, _ = p.place(r.url)
        menu = "".join(f"<li>{w} of {host}</li>" for w in ("Home", "News", "About"))
        inner = whole.search(r.html)[1]
        truth[r.page_id] = "\n".join(t for _, t in p.blocks(inner))
        made.append((r.page_id, r.url, f"<body><ul>{menu}</ul><div id=content>{inner}</div><div>(c) {host}</div></body>"))
    got = {r.page_id: r.text for r in p.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    hosts = [p.place(r.url)[0] for r in rows]
    paired = [r.page_id for r in rows if hosts.count(p.place(r.url)[0]) > 1]
    assert sum(got[i] == truth[i] for i in paired) > 0.9 * len(paired) > 100
    assert not any("Home of" in got[i] or "(c)" in got[i] for i in paired)


def test_query(spark):
    from quillmesh.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    whole = re.compile("<article>(.*)</article>", re.S)
    want = {r.page_id: (r.url, "\n".join(t for _, t in p.blocks(whole.search(r.html)[1]))) for r in rows}
    got = queries.op5_pages(spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)
