import html
import re

from pyspark.sql import functions as F

from ledgerline.llm import queries as Q
from ledgerline.llm.html_text import extract_main_text, main_text

P1, P2 = "First paragraph with enough plain words to read well, and some more.", "Second &amp; last paragraph&nbsp;here, which is also rather long text."
ARTICLE = f"<h1>Title here</h1><p>{P1}</p><p>{P2}<br>tail line</p>"
WANT = f"Title here\n{P1}\nSecond & last paragraph here, which is also rather long text.\ntail line"


def test_article_and_what_is_beside_it():
    menu = "".join(f'<li><a href="/{k}">menu entry {k}</a></li>' for k in range(30))
    page = (f"<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><header>Site</header>"
            f"<nav><ul>{menu}</ul></nav><div class='sidebar'><p>{P1 * 3}</p></div><article>{ARTICLE}</article><!-- <p>no</p> -->"
            f"<div id='cookieNotice'>{P1 * 9}</div><form><p>Field {P1}</p></form><section class='user-comments'><p>{P1 * 5}</p></section>"
            f"<div class=ad>{P1}</div><footer><p>{P1 * 4}</p></footer></body></html>")
    assert main_text(page) == WANT
    assert main_text(page.replace("<article>", "<div><div>").replace("</article>", "</div></div>")) == WANT


def test_untagged_link_list_and_sections():
    links = "<div>" + "".join(f'<a href="{k}">go to page {k}</a> ' for k in range(40)) + "</div>"
    parts = "".join(f"<section><h2>Part {k}</h2><p>{P1} {k}</p><p>{P1} again {k}</p></section>" for k in range(4))
    want = "\n".join(f"Part {k}\n{P1} {k}\n{P1} again {k}" for k in range(4))
    assert main_text(f"<body>{links}<main>{parts}</main>{links}</body>") == want


def test_markup():
    assert main_text("<p>a <b>b</b>\n c<p>d &lt;e&gt; &#233; &amp;amp; 1 < 2 <i>x</p>tail") == "a b c\nd <e> é &amp; 1 < 2 x\ntail"
    assert main_text("<p>unclosed <b>bold<br><p>next") == "unclosed bold\nnext"
    assert main_text("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table>") == "one\ntwo\nc1\nc2\nc3"
    assert main_text('<p title="a > b">x</p><p hidden>no</p><p style="display: none">no</p><p>y') == "x\ny"
    assert main_text("plain text only") == "plain text only"
    for empty in (None, "", " \n", "<html><body></body></html>", "<script>x", "<!-- open", "<p", "<>", "</p>"):
        assert main_text(empty) in ("", "<>")
    assert main_text("<div>" * 20_000 + "deep words" + "</div>" * 20_000) == "deep words"
    long = " ".join(f"w{k}" for k in range(200_000))
    assert main_text(f"<article><p>{long}</p></article>") == long


def test_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, f"<p>{P1}</p>"), (3, "v", f"<article>{ARTICLE}</article>"), (3, "v", f"<article>{ARTICLE}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = extract_main_text(df, out="main")
    assert got.columns == [*df.columns, "main"]
    assert sorted((str(r.page_id), r.main) for r in got.collect()) == sorted([("1", ""), ("2", ""), ("None", P1), ("3", WANT), ("3", WANT)])
    assert extract_main_text(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in Q.op6_html_main_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = r.html[r.html.index("<article>"):r.html.index("</article>")]
        want = "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", inside)) if t)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_everyday_words_inside_the_article():
    marked = f"<section id='discussion'><h2 id='related-work'>Related work</h2><p>{P1}</p></section><div class='post-header'><h1>Title</h1></div><p>{P1} end</p>"
    assert main_text(f"<body><article>{marked}</article></body>") == f"Related work\n{P1}\nTitle\n{P1} end"
    assert main_text(f"<body><div><h2 id='search-and-share'>Search and share</h2><p>{P1}</p><p>{P1} end</p></div></body>") == f"Search and share\n{P1}\n{P1} end"


def test_article_in_sibling_containers():
    for n in (2, 3):
        parts = ["".join(f"<p>{P1 * 3} {k} {j}</p>" for j in range(3)) for k in range(n)]
        want = "\n".join(f"{P1 * 3} {k} {j}" for k in range(n) for j in range(3))
        assert main_text("<body>" + "".join(f"<div>{x}</div>" for x in parts) + "</body>") == want


BODY = f"<h1>Title here</h1><p>{P1}</p><p>{P1} end</p>"
BODY_TEXT = f"Title here\n{P1}\n{P1} end"


def test_layout_words_do_not_hide_the_article():
    for page in (f'<div class="layout has-sidebar"><article>{BODY}</article></div>', f'<div class="search-results-page"><article>{BODY}</article></div>',
                 f'<div id="social-science"><article>{BODY}</article></div>', f'<main><div class="content no-comments">{BODY}</div></main>',
                 f'<form action="/x"><div><article>{BODY}</article></div><input value="v"><button>Go</button></form>',
                 f'<form><div class="sidebar"><p>menu</p></div>{BODY}</form>', f'<div class="sidebar"><div>{BODY}</div></div>',
                 f'<div class="page-header"></div><div class="widget"><main>{BODY}</main></div><div class="comments"><p>{P1}</p></div>'):
        assert main_text(f"<body>{page}</body>") == BODY_TEXT, page


def test_titles_and_sections_of_a_page_without_an_article_element():
    page = f"<div class='post-header'><h1>Title here</h1></div><div><p>{P1}</p><section id='discussion'><h2>Discussion</h2><p>{P1} end</p></section></div>"
    assert main_text(f"<body><div>{page}</div></body>") == f"Title here\n{P1}\nDiscussion\n{P1} end"
    for word in ("search", "share", "social", "notice", "related", "skip"):
        assert main_text(f"<body><div>{BODY}<section id='{word}'><h2>{word}</h2><p>{P1} {word}</p></section></div></body>") == f"{BODY_TEXT}\n{word}\n{P1} {word}"


def test_reader_comments_and_adverts_inside_the_article_go_without_links():
    for mark in ("class='comments'", "id=comments", "class='user-comments'", "class='commentlist'", "class=ad", "class='ad-box'", "class='sponsored'",
                 "class='newsletter'", "id='newsletterBox'", "class='cookie-notice'"):
        assert main_text(f"<body><article>{BODY}<div {mark}><p>{P1} beside</p><p>{P1} more</p></div></article></body>") == BODY_TEXT, mark
    kept = f"<div class='discussion'><p>{P1} own</p></div>"
    assert main_text(f"<body><article>{BODY}{kept}</article></body>") == f"{BODY_TEXT}\n{P1} own"


def test_more_comments_than_article():
    page = f"<article>{BODY}</article><div class='comments'>" + f"<p>{P1} said</p>" * 40 + "</div>"
    assert main_text(f"<body>{page}</body>") == BODY_TEXT
    assert main_text(f"<body><div>{BODY}</div><div class='comments'>" + f"<p>{P1} said</p>" * 40 + "</div></body>") == BODY_TEXT


def test_deep_nesting_is_linear():
    import time

    def seconds(n, page):
        start = time.perf_counter()
        assert main_text(page(n)) != ""
        return time.perf_counter() - start
    for page in (lambda n: "<div class='x'>" * n + "deep words", lambda n: "<span id=a>" * n + "deep words" + "</p>" * n,
                 lambda n: "<i>" * n + "deep words" + "</b>" * n, lambda n: "<ul><li class=x>" * n + "deep words"):
        assert seconds(100_000, page) < 40 * max(0.05, seconds(10_000, page))       # quadratic work would take 100 times


def brute_density(node):
    """(characters, link characters, tags, link tags) of a subtree, by plain recursion."""
    c = l = t = lt = 0
    for x in node.children:
        if isinstance(x, str):
            c += len("".join(x.split()))
        elif not x.dropped:
            a, b, d, e = brute_density(x)
            c, l, t, lt = c + a, l + b, t + d + 1, lt + e
    return (c, c, t, lt + 1) if node.tag == "a" else (c, l, t, lt)


def test_densities_and_anchor_by_brute_force():
    import math
    import random

    from ledgerline.llm import html_text as H

    rng = random.Random(4)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.randrange(12)
        tag = rng.choice(["div", "p", "a", "section", "span", "ul"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(4))) + f"</{tag}>"
    for _ in range(200):
        body = H.parse("<body>" + "".join(tree(4) for _ in range(3)) + "</body>")
        H.leave_out(body)
        nodes = H.measure(body)
        c, l, _, _ = brute_density(body)
        whole = l / max(1, c)
        value = {}
        for n in nodes:
            c, l, t, lt = brute_density(n)
            t, lt = max(1, t), max(1, lt)
            base = math.log(c * l / max(1, c - l) + whole * c + math.e)
            value[id(n)] = c / t * math.log(max(1.0, c / max(1, l) * t / lt) + 1) / base if c else 0.0
            assert math.isclose(n.density, value[id(n)], abs_tol=1e-9)
        sums = {id(n): sum(value[id(x)] for x in n.children if not isinstance(x, str) and not x.dropped) for n in nodes}
        assert math.isclose(max(n.total for n in nodes), max(sums.values()), abs_tol=1e-9)
