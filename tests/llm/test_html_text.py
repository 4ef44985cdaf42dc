import itertools
import re
from html import unescape

import numpy as np
import pytest

from tracksift.llm import html_text as H
from tracksift.llm import queries as Q
from tests.llm.conftest import SF


def test_query_returns_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = Q.op10_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        a = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        a = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", a))
        assert r.text == re.sub(r"\s+", " ", unescape(a)).strip() and r.n_chars == len(r.text)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    nodes = H.parse("<div class='nav'><p>a<b>c</b></p><ul><li>x</li></ul></div><p>tail</p>")[0]
    t = H.forest([nodes])
    w = H.Weights(rng.normal(size=H.N_FEATURES), rng.normal(size=(len(H._KINDS), 2, 2)))
    own = np.bincount(t.owner, w.unary[t.feature], minlength=len(nodes))
    total, each, pairs = 0.0, np.zeros(len(nodes)), np.zeros((len(nodes), 2, 2))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = np.exp(sum(own[i] for i in range(len(y)) if y[i]) + sum(w.edge[t.kind[i], y[t.parent[i]], y[i]] for i in range(1, len(y))))
        total += s
        each += s * np.array(y)
        for i in range(1, len(y)):
            pairs[i, y[t.parent[i]], y[i]] += s
    p, pair, log_z = H.marginals(w, t)
    assert np.allclose(p, each / total) and np.allclose(pair[1:], pairs[1:] / total) and log_z == pytest.approx(np.log(total))


def test_held_out_layouts():
    """Layouts and words that the training pages don't have."""
    body = "<p>" + "The valley was quiet that winter and nobody came. " * 4 + "</p>"
    text = re.sub(r"<[^>]+>", "", body).strip()
    pages = {
        f"<body><div id='top-menu'><a href=/>Start</a><a href=/b>Blog</a></div><div class='main-content'><h2>Winter</h2>{body}</div><div class='right-sidebar'>{body}</div></body>": f"Winter {text}",
        f"<html><head><title>T</title></head><body><header>My page</header><main><h1>Head</h1>{body}{body}</main><section class='user-comments'>{body}</section><footer>(c)</footer></body></html>": f"Head {text} {text}",
        f"<body><div class='cookie-banner'>{body}</div><article>{body}<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- {body} --></article></body>": text,
        f"<article><p>AT&amp;T &#233;t&eacute; <i>x</i>y  z</p>{body}</article>": f"AT&T été xy z {text}",
    }
    w = H.default_weights()
    assert H.main_texts(w, list(pages)) == list(pages.values())


def test_odd_rows(spark):
    rows = [(1, "u", None, "old", 5), (2, None, "", "x", 1), (None, "u", "<article><p>open <b>never <!-- closed", "x", 1), (4, "u", "plain", None, None), (4, "u", "plain", None, None), (5, "u", "</p></div><" + "<div>" * 3000 + "x", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(df)
    assert set(got.columns) == {"page_id", "url", "text", "n_chars"} and len(got.collect()) == 6
    by = {r.page_id: r.text for r in got.collect()}
    assert by[1] == by[2] == "" and by[None] == "open never"
    assert H.extract(df.limit(0)).collect() == []
    long = "<article>" + "<p>word word</p>" * 30000 + "</article>"
    assert H.main_texts(H.default_weights(), [long])[0].count("word") == 60000


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>T</title><meta charset=utf-8><body><article><p>{}</p></article></body></html>",
        "<head><title>T</title><p>{}</p>",
        "<article><svg width='1'/><p>{}</p></article>",
        "<article><iframe src='x'/><p>{}</p></article>",
        "<article><svg><p>{}</p></article>",
        "<article><svg><title>no</title><path/></svg><p>{}</p><canvas></article>",
        "{}",
    ],
)
def test_open_and_self_closed_elements_lose_no_text(html):
    body = "The valley was quiet that winter and nobody came. It snowed for days, and the road was closed."
    assert H.main_texts(H.default_weights(), [html.format(body)]) == [body]


def test_many_open_elements_take_linear_time():
    body = "The valley was quiet that winter and nobody came."
    page = "<article>" + "<svg>" * 50_000 + f"<p>{body}</p></article>"
    assert H.main_texts(H.default_weights(), [page]) == [body]


def test_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "a", "b")], "page_id long, html string, `_html` string, `odd name` string")
    assert H.extract(df).columns == ["page_id", "_html", "odd name", "text", "n_chars"]
