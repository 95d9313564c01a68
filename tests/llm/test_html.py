"""Main text of pages, and repeated runs against brute force."""

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from lodestrata.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="ad-free"><header>Site</header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy <div>now</div></div><!-- <p>no</p> --><article><h1>Title &amp; more</h1>
<p><b>One  two<br>three</b> <a href=x>link</a>&nbsp;end<p>Second<table><tr><td>c1<td>c2</table><aside>side</aside><div class='comments'><p>Reader</p></div>
<form><input name=q><p>Ask</p></form></article><footer>&copy; x</footer></body>"""


def test_article_without_furniture():
    assert html.main_texts([PAGE]) == [("Title & more\nOne two three link end\nSecond\nc1\nc2", 0)]


@pytest.mark.parametrize(
    "page",
    [
        '<main class="has-sidebar"><p>Kept text</p></main>',
        '<article class="post no-comments"><p>Kept text</p></article>',
        '<article data-id="ad-7" data-class="ad"><p>Kept text</p></article>',
        '<div class="ad-free"><article><p>Kept text</p></article></div>',
        '<div id="related-work"><article><p>Kept text</p></article></div>',
        '<article><p class="share-price">Kept text</p></article>',
        '<article><div class="share-box">Kept text</div><div title="class=ad" class=x>more</div></article>',
    ],
)
def test_parts_of_names_take_nothing(page):
    assert html.main_texts([page])[0][0].startswith("Kept text")


def test_names_of_furniture():
    gone = '<div class="site-header">a</div><div id="sidebar-2">b</div><div class="x cookie-notice">c</div><div class=adBanner>d</div><div class="comment-list">e</div><div role="navigation">f</div>'
    assert html.main_texts([f"{gone}<article>Kept <div class='ad'>no</div><section class='comments'>no</section></article>{gone}"]) == [("Kept", 0)]


def test_open_text_loses_repeated_runs_only():
    run = "this very line stands on every page of the host"
    pages = [f"<body><div>{run}</div><div>own{k} words{k} {run} tail{k}</div><article>{run}</article></body>" for k in "ab"]
    texts = [t for t, _ in html.main_texts(pages)]
    assert texts == [f"own{k} words{k} tail{k}\n{run}" for k in "ab"]
    assert html.main_texts(pages[:1])[0][0].count(run) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=4), st.integers(1, 5))
def test_repeated_equals_brute_force(streams, long):
    got = html.repeated([np.array(s, np.int64) for s in streams], long)
    for k, s in enumerate(streams):
        want = [False] * len(s)
        for i in range(len(s) - long + 1):
            window = s[i : i + long]
            if any(o[j : j + long] == window for n, o in enumerate(streams) if n != k for j in range(len(o) - long + 1)):
                want[i : i + long] = [True] * long
        assert got[k].tolist() == want


def test_extract_tables(llm_spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "nohost", ""), (1, "http://a.example/x", PAGE), (None, "https://u@B.example:80/", "<article>ü &lt;b&gt;</article>"), (4, "http://a.example/", "<article>" + "long text " * 50_000 + "</article>")]
    rows += [(100 + i, "http://hot.example/", f"<nav>m</nav><article>page {i}</article>") for i in range(300)]
    df = llm_spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id bigint, url string, html string, host string, deal int")
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == by[3] == "" and by[None] == "ü <b>" and by[150] == "page 50" and len(by[4]) == 499_999
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(df.filter("false")).count() == 0


def test_extract_equals_brute_force_over_a_whole_host(llm_spark):
    # 65 and more pages, a page of over 1 MB, and runs that only two far pages share
    def page(i):
        shared = "a line of eight words or some more that stands here " * (i % 13 == 0)
        pair = f"pair {i % 70} of pages far apart share these nine words "
        return f"<body><div>this very line stands on every page of the host</div><div>own{i} {pair}{shared}tail{i}</div><article>text of {i}</article></body>"

    pages = [page(i) for i in range(140)] + ["<body><div>this very line stands on every page of the host</div><p>" + " ".join(f"w{i}" for i in range(200_000)) + "</p></body>"]
    for n in (65, len(pages)):
        some = pages[-n:]
        rows = [(i, f"http://one.example/{i}", p) for i, p in enumerate(some)] + [(1000, "http://other.example/", pages[0])]
        got = {r["page_id"]: r["text"] for r in html.extract(llm_spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert [got[i] for i in range(n)] == [t for t, _ in html.main_texts(some)]
        assert "this very line" in got[1000] and not any("this very line" in got[i] for i in range(n))


def test_copies_count_as_one_page(llm_spark):
    story = "<body><div>a story of more than eight words that stands in no article at all</div></body>"
    rows = [(i, f"http://copies.example/story?utm_source={i}", story) for i in range(130)] + [(200, "http://copies.example/other", "<body><div>quite another page</div></body>")]
    got = {r["page_id"]: r["text"] for r in html.extract(llm_spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(130)} == {"a story of more than eight words that stands in no article at all"} and got[200] == "quite another page"
    assert html.main_texts([r[2] for r in rows]) == [(got[r[0]], 0) for r in rows]


def test_a_notice_inside_of_articles_goes(llm_spark):
    notice = "All of our texts are free to read and may be shared by anyone."
    few = "This sentence of more than eight words stands on a few pages."
    pages = [f"<article><p>{notice}</p><p>story {i} of this host</p>{f'<p>{few}</p>' * (i % 5 == 0)}</article>" for i in range(80)] + [f"<main><p>{notice}</p></main>"]
    rows = [(i, f"http://notice.example/{i}", p) for i, p in enumerate(pages)] + [(1000, "http://other.example/", pages[1])]
    got = {r["page_id"]: r["text"] for r in html.extract(llm_spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "story 1 of this host" and got[5] == f"story 5 of this host\n{few}"
    assert got[80] == notice and got[1000] == f"{notice}\nstory 1 of this host"
    assert [got[i] for i in range(81)] == [t for t, _ in html.main_texts(pages)]


def test_sentences_of_the_host_inside_of_paragraphs_go(llm_spark):
    line = "Read more of our stories on the pages of this site."
    pages = [f"<article><p>Story {i} begins. {line} It ends {i}.</p><p>{line}</p></article>" for i in range(40)]
    rows = [(i, f"http://lines.example/{i}", p) for i, p in enumerate(pages)] + [(100 + i, "http://few.example/", p) for i, p in enumerate(pages[:9])]
    table = html.extract(llm_spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in table.collect()}
    assert [got[i] for i in range(40)] == html.main_texts(pages) == [(f"Story {i} begins. It ends {i}.", 22) for i in range(40)]
    assert [got[100 + i] for i in range(9)] == html.main_texts(pages[:9]) == [(f"Story {i} begins. {line} It ends {i}.\n{line}", 0) for i in range(9)]
