"""Main text of pages."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from platen.llm import wrapper

PLAIN = "<html><body><div class=x>Welcome to the site</div><div><span>Home</span><span>About</span></div><div id=c%d><p>%s</p><p>%s</p></div><div>All rights reserved</div></body></html>"
FULL = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-1">Buy</div><article><header><h1>Title &amp; more</h1></header><p>One  <b>two</b>&nbsp;three<p>Four<br>five<ul><li>a<li>b</ul><aside>see also</aside>
<form><input value=x>Sign up</form><section class="comments"><article class="comment">first!</article></section><script>x()</script><!-- no --></article><footer>&copy; 2020</footer></body></html>"""


def test_article_without_its_surroundings():
    assert wrapper.main_text(FULL) == "Title & more\nOne two three\nFour five\na\nb"
    assert wrapper.main_text(None) == wrapper.main_text("") == wrapper.main_text("<p></p>") == ""
    assert wrapper.main_text("<main><p>a</main>x") == "a" and wrapper.main_text("<div role=main>b</div>x") == "b"
    assert wrapper.main_text("<article class=comment>no</article><p>yes") == "yes"
    assert wrapper.main_text("a < b & c &lt;d&gt; <p>x</p") == "a < b & c <d>\nx"


def test_wrapper_of_pages_without_an_article():
    pages = [PLAIN % (i, f"text {i}", f"more {i * i}") for i in range(4)]
    w = wrapper.induce(pages[:3])
    assert wrapper.main_text(pages[3], w) == "text 3\nmore 9"
    assert wrapper.main_text(pages[0], wrapper.induce([pages[0], pages[0]])).startswith("Welcome")  # of equal pages one counts


def _random_tree(rnd, depth):
    tree = wrapper.Tree(rnd.choice("ab"))
    if depth:
        tree.kids = [_random_tree(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return tree


def _brute_weight(a, b):
    """Simple tree matching by trying all ordered pairings of children."""
    if a.label != b.label:
        return 0

    def best(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + _brute_weight(a.kids[i], b.kids[j]))

    return 1 + best(0, 0)


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_tree_matching_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "TABLE_CELLS", cells)
    rnd = random.Random(6)
    for _ in range(400):
        a, b = _random_tree(rnd, 3), _random_tree(rnd, 3)
        b.label = a.label
        matching = wrapper.Matching()
        pairs = matching.align(a, b)
        assert len(pairs) == matching.weight(matching.number(a), matching.number(b)) == _brute_weight(a, b)
        assert all(x.label == y.label for x, y in pairs)
        size = len(wrapper._nodes(a)) + len(wrapper._nodes(b))
        matching.merge(a, b, 1)
        assert len(wrapper._nodes(a)) == size - len(pairs) and wrapper.written(wrapper.read_tree(wrapper.written(a))) == wrapper.written(a)


def test_merging_in_rounds_keeps_the_template(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "GROUP", 2)
    rows = [(i, "http://a.com/", PLAIN % (i, f"text {i}", f"more {i}") + "".join(f"<section><h3>s{i} {k}</h3></section><p>p{i} {k}</p>" for k in range(i % 7))) for i in range(21)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(21):
        assert got[i] == "\n".join([f"text {i}", f"more {i}", *(x for k in range(i % 7) for x in (f"s{i} {k}", f"p{i} {k}"))])


def test_hosts_without_articles(spark):
    """Half of the hosts have no article; their menus and notices are constant, the others' vary."""
    rows, want = [], {}
    for h in range(6):
        for i in range(8):
            k = 10 * h + i
            body = f"<div class='entry-header'><h1>Title {k}</h1></div><p>Body {k} with some words.</p><div id=related-work><h4>Related work</h4><p>Work {k}</p></div>"
            if h % 2:
                page = f"<nav><a>n{k}</a></nav><div class=ad>buy {k}</div><article>{body}</article><div class=related-posts>other {k}</div><footer>{k}</footer>"
                want[k] = f"Title {k}\nBody {k} with some words.\nRelated work\nWork {k}"
            else:
                page = f"<div class=top>Site of host {h}</div><ul><li>Home<li>News<li>Imprint</ul><div class=c><div class=x{k}>{body}</div></div><div>All rights reserved</div>"
                want[k] = f"Title {k}\nBody {k} with some words.\nWork {k}"
            rows.append((k, f"https://h{h}.org/{i}", f"<html><body>{page}</body></html>"))
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in want.items():
        # "Related work" stands on all pages of a host, so it is template there, inside an article too.
        assert got[k] == text.replace("Related work\n", "")
        assert wrapper.main_text(rows[[r[0] for r in rows].index(k)][2]) != got[k]  # the wrapper makes the difference


def test_names_of_elements():
    for kept in ("<div class=entry-header><h1>t</h1></div>", "<section id=related-work>t</section>", "<div class=menu-planning>t</div>", "<div class=sidebar-layout><main>t</main></div>"):
        assert wrapper.main_text(f"<article>{kept}</article>") == "t", kept
    for cut in ("<div class=related-posts>x</div>", "<div class='site-header'>x</div>", "<div class=commentList>x</div>", "<p class='big cookie-banner-box'>x</p>", "<article class=comment><h2>x</h2></article>"):
        assert wrapper.main_text(f"<p>t</p>{cut}") == "t", cut


def test_deep_and_long_pages_end():
    assert wrapper.main_text("<div>" * 20_000 + "x") == "x"
    assert wrapper.main_text("<b>" * 5000 + "y" + "</i>" * 5000) == "y"
    many = "<p>word</p>" * 20_000
    assert wrapper.main_text(f"<article>{many}</article>").count("\n") == 19_999
    assert wrapper.main_text("<" * 50_000 + " z").endswith("z")
    for unit in ("<a", "<a '", '<a ">', "<!--", "<p", "</", "&#", "<script>", "<![CDATA["):
        wrapper.main_text(unit * 50_000)
        wrapper.main_text(unit * 50_000 + ">")


def test_pages_table_against_its_generator(spark):
    for r in wrapper.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", s)).split()) for s in re.split(r"</?(?:p|h1)[^>]*>", re.sub("<br>", " ", article)))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_hosts_and_odd_rows(spark):
    rows = [(i, f"http://A.com/{i}", PLAIN % (i, f"text {i}", f"more {i * i}"), "x") for i in range(40)]
    rows += [(3, "http://A.com/3", PLAIN % (3, "text 3", "more 9"), "x"), (100, None, FULL, "x"), (101, "http://b.com/", PLAIN % (1, "only", "page"), "y"), (102, "x", None, None), (None, "http://a.com/q", PLAIN % (7, "null id", "here"), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in wrapper.extract(pages).collect()}
    assert all(got[i, f"http://A.com/{i}"] == f"text {i}\nmore {i * i}" for i in range(40))
    assert got[None, "http://a.com/q"] == "null id\nhere" and got[102, "x"] == "" and got[100, None].startswith("Title")
    assert got[101, "http://b.com/"].startswith("Welcome to the site\nHomeAbout\nonly\npage")
    assert wrapper.extract(pages).count() == len(rows) and wrapper.extract(pages.filter(F.lit(False))).count() == 0


def test_template_inside_articles_and_teasers(spark):
    """Constant text goes inside article too; teaser cards don't hide a body in a div; each layout has its own template."""
    one = "<article><h1>T%d</h1><p>Subscribe to our letter</p><p>body %d is the text of this page</p></article>"
    two = "<article class=card>Teaser</article><article class=card>Other</article><div class=body><p>Long body number %d of the second layout</p></div><div class=legal>Imprint</div>"
    rows = [(i, f"http://h.com/{i}", one % (i, i) if i < 12 else two % i) for i in range(20)]
    # A passage that fewer pages share is content, wherever the first few pages show it.
    rows += [(20 + i, f"http://k.com/{i}", f"<div><p>{'same' if i < 6 else f'own {i}'}</p><p>text {i}</p></div><div class=f>Foot</div>") for i in range(12)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == (f"T{i}\nbody {i} is the text of this page" if i < 12 else f"Long body number {i} of the second layout")
    assert all(got[20 + i] == f"{'same' if i < 6 else f'own {i}'}\ntext {i}" for i in range(12))


def test_template_after_many_runs():
    """A footer behind more than 400 sibling runs is template as well."""
    pages = ["".join(f"<p>a{k} of {i}</p><div>b{k} of {i}</div>" for k in range(300)) + "<h6>Foot</h6>" for i in range(4)]
    assert "Foot" not in wrapper.main_text(pages[0], wrapper.induce(pages))


def test_attributes_are_read_by_exact_name():
    for kept in ('title="a hidden gem"', 'data-hidden="false"', "style=overflow:hidden", 'data-id="share-3"', "data-role=menu", 'alt="class=menu"', "title='id=ad'"):
        assert wrapper.main_text(f"<div {kept}>text</div>") == "text", kept
    for cut in ("hidden", 'HIDDEN=""', "title=x hidden", "class=menu", "id = 'share-3'", 'a="b"role="menu"', "aria-hidden=true"):
        assert wrapper.main_text(f"<p>a</p><div {cut}>text</div>") == "a", cut
