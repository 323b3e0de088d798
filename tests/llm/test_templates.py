"""Template deduction: parsing of careless markup, classes of occurrence vectors, the extracted text."""

import html
import random
import re
from collections import defaultdict

import pytest

from panelflow.llm import markup as H
from panelflow.llm import templates as T
from tests.conftest import SF

WORDS = "river stone lamp quiet orange seven window garden paper cloud north salt".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def texts(spark, rows, schema="page_id long, url string, html string"):
    return {r.page_id: r.text for r in T.main_texts(spark.createDataFrame(rows, schema).repartition(3)).collect()}


def one(body):
    return T.slot_text(H.parse(body), set(), set(), set())


@pytest.mark.parametrize(("body", "want"), [
    ("", ""), ("plain words", "plain words"), ("a < b and 3 <4", "a < b and 3 <4"),
    ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
    ("<article><h1>T</h1><p><b>x<br><p>y</article>z", "T\nx\ny"),
    ("<article>fish &amp; chips &lt;p&gt; &#x41;&#66; &copy; &amp &nbsp; end</article>", "fish & chips <p> AB © & end"),
    ("<article>a<!-- <p>no</p> --> b<script>var t='</p>';if(a<b)</script>c<style>p{}</style></article>", "a bc"),
    ("<article><p>in<b>li</b>ne <i> x </i></p><ul><li>one<li>two<ul><li>deep</ul></ul></article>", "inline x\none\ntwo\ndeep"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table>t</article>", "a\nb\nc\nt"),
    ("<ARTICLE CLASS=post><P>Upper</P></ARTICLE><FOOTER>no</FOOTER>", "Upper"),
    ("<main><p>m</p><aside>s</aside><form><input value='x'>f<button>b</button></form></main>", "m"),
    ("<header><h1>Site</h1></header><article><header><h1>Own</h1></header>t<section class='comments'><p>first!</p></section></article>", "Own\nt"),
    ("<div id=comments><article class=comment><p>long long comment text that is the most of all</p></article></div><article>t</article>", "t"),
    ("<div class='cookie-notice'>we use cookies</div><div class=content><p>x</p></div><div class='sideBar'>s</div>", "x"),
    ("<div hidden>h</div><div style='display: none'>n</div><div><p>t t</p></div>", "t t"),
    ("<article><p title='a > b'>q</p><a href=\"x>y\">l</a></article>", "q\nl"),
    ("<article>unclosed <b title=\"quote>text</article>", "unclosed text"),
    ("<article>end<", "end<"), ("<article>end<p class", "end"), ("<article>x<!-- open", "x"), ("<title>t</title>body", "body"),
])
def test_one_page(body, want):
    assert one(body) == want


def test_long_and_deep_pages():
    assert one("<article>" + "<p>word word</p>" * 20000 + "</article>").count("\n") == 19999
    assert one("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert one("<" * 20000) == "<" * 20000
    assert one("<article>" + "a " * 500_000) == " ".join(["a"] * 500_000)


LAYOUT = """<html><head><title>{t}</title></head><body><div class="q1"><a href="/">Home</a><a href="/n">News {k}</a><a href="/z">More about all of our things</a></div>
<div class="q2"><div class="q3"><h2>{t}</h2><p>{a}<p>{b}<p>Sign up to read page {k}.</div><p>All rights of every reader are kept by the house.</p></div>
<div class="q4">{n} people liked page {k}</div></body></html>"""


def site(rnd, n, host):
    """Pages whose class names say nothing; titles and paragraphs are the main text."""
    pages, want = [], {}
    for k in range(n):
        t, a, b = prose(rnd, 4) + f" {k}", prose(rnd, 60), prose(rnd, 40)
        pages.append((k, f"https://{host}/p/{k}", LAYOUT.format(t=t, a=a, b=b, k=k, n=rnd.randrange(99))))
        want[k] = f"{t}\n{a}\n{b}"
    return pages, want


def test_neutral_names_by_mass_and_constant_text(spark):
    rnd = random.Random(4)
    pages, want = site(rnd, 30, "one.example.net")
    assert texts(spark, pages) == want


def test_constant_text_inside_the_main_element(spark):
    """Text that every page of the host has goes; without the host's other pages it would stay."""
    rnd = random.Random(5)
    rows = [(k, "http://h.example.org/x", f"<article><p>{prose(rnd, 50)} {k}</p><p>Read more in our paper, page {k}.</p><p>{prose(rnd, 30)}</p></article>")
            for k in range(20)]
    got = texts(spark, rows)
    for k, _, body in rows:
        a, _, b = re.findall("<p>(.*?)</p>", body)
        assert got[k] == f"{a}\n{b}"
    assert "Read more" in texts(spark, rows[:1])[0]


def test_copies_are_no_template(spark):
    same = "<html><body><nav>m</nav><article><h1>One</h1><p>a b c d</p><p>e f g</p></article></body></html>"
    rows = [(k, "http://copies.example.org/x", same) for k in range(12)]
    assert set(texts(spark, rows).values()) == {"One\na b c d\ne f g"}
    near = [(k, "http://near.example.org/", same.replace("e f g", f"e {'xyzw'[k % 4]} g" if k < 7 else prose(random.Random(k), 9))) for k in range(12)]
    got = texts(spark, near)
    assert all(v.startswith("One\na b c d\n") for v in got.values())


def test_rows_without_url_or_html(spark):
    art = "<article><p>x</p></article>"
    rows = [(1, None, art, "a"), (2, "http://a.example.net/", None, "b"), (3, "no url", ""
            , "c"), (None, "http://a.example.net/", art, "d"), (1, None, art, "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in T.main_texts(df).collect())
    assert got == [(0, "http://a.example.net/", "x"), (1, "", "x"), (1, "", "x"), (2, "http://a.example.net/", ""), (3, "no url", "")]
    assert T.main_texts(df.limit(0)).collect() == []
    clash = df.withColumnRenamed("text", "host").withColumnsRenamed({})
    assert T.main_texts(clash).columns == ["page_id", "url", "text"]


def test_classes_are_the_occurrence_vectors(spark):
    """The hashed vectors join exactly the tokens whose counts agree on every page."""
    rnd = random.Random(8)
    rows = []
    for k in range(25):
        body = "".join(f"<div class='d{chr(97 + rnd.randrange(4))}'><span>{rnd.choice(WORDS)}</span></div>" * rnd.randrange(3) for _ in range(3))
        rows.append((rnd.choice(["a", "b"]), f"<html><body>{body}</body></html>"))
    found = T.tokens(spark.createDataFrame(rows, "host string, html string").repartition(4)).collect()
    vectors = defaultdict(lambda: defaultdict(int))
    for i, (host, body) in enumerate(rows):
        for key, count, _, _ in T._page_tokens(H.parse(body)):
            vectors[host, key[0]][i] += count
    assert {(r.host, r.role) for r in found} == set(vectors)
    by_hash, by_vector = defaultdict(set), defaultdict(set)
    for r in found:
        assert r.pages == len(vectors[r.host, r.role]) and r.total == sum(vectors[r.host, r.role].values())
        by_hash[r.host, r.low, r.high].add(r.role)
    for (host, r), v in vectors.items():
        by_vector[host, tuple(sorted((hash(rows[i][1]), n) for i, n in v.items()))].add(r)
    assert sorted(map(sorted, by_hash.values())) == sorted(map(sorted, by_vector.values()))


def test_template_is_used(spark):
    """Without the deduced template the constant text and the neutral furniture of the layout stay."""
    pages, want = site(random.Random(4), 30, "one.example.net")
    alone = {k: T.slot_text(H.parse(body), set(), set(), set()) for k, _, body in pages}
    assert any(alone[k] != want[k] for k in want)
    known = T.templates(spark.createDataFrame([("h", b) for _, _, b in pages], "host string, html string")).collect()
    assert len(known) == 1 and known[0].main


def test_query(spark):
    """The driver's pages: the article's heading and paragraphs."""
    got = {r.page_id: r for r in T.op12_templates(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url
