from __future__ import annotations

import pytest

from labelloom.llm.html_extract import best_region, extract_main_text, fit_weights, main_text, page_items, weight_of

HEAD = '<!DOCTYPE html><html><head><title>T w</title><style>p{}</style></head><body>'
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News page</a></li></ul></nav>'
FOOT = "<footer>&copy; site &middot; all rights</footer></body></html>"


def page(body):
    return HEAD + NAV + '<div class="ad">Buy this thing now please</div>' + body + FOOT


ARTICLE = "<article><h1>A title</h1><p>First  part\n of it.</p><p><b>Second &amp; more<br>lines</p></article>"
CASES = {
    "plain": (page(ARTICLE), "A title\nFirst part of it.\nSecond & more lines"),
    "comments": (page(ARTICLE.replace("</article>", '<section id="comments"><p>Nice one, I agree a lot</p></section></article>')), "A title\nFirst part of it.\nSecond & more lines"),
    "notice and form": (page('<div class="cookie-notice"><p>We use cookies</p></div>' + ARTICLE + "<form><label>Mail</label><input></form>"), "A title\nFirst part of it.\nSecond & more lines"),
    "script in text": (page("<article><p>Before<script>var t='</p>more words here';</script> after</p></article>"), "Before after"),
    "comment in text": (page("<article><p>Before<!-- <p>hidden</p> --> after</p></article>"), "Before after"),
    "open menu": (HEAD + "<nav><ul><li>Menu<article><p>Kept text here</p></article>" + FOOT, "Kept text here"),
    "cut off": (HEAD + NAV + "<article><h1>One</h1><p>Two thr", "One\nTwo thr"),
    "references": (page("<article><p>&lt;b&gt; &#233;&nbsp;&#x20AC; &amp &am</p></article>"), "<b> é € & &am"),
    "list and table": (page("<article><ul><li>a1</li><li>b1</li></ul><table><tr><td>c1</td><td>d1</td></tr></table></article>"), "a1\nb1\nc1 d1"),
    "quoted bracket": (page('<article><p title="a > b">Text</p></article>'), "Text"),
    "has-sidebar": (page('<article><div class="post has-sidebar"><p>Body text</p></div><aside>Side</aside></article>'), "Body text"),
    "no article": (page("<div id='content'><h1>Head line</h1><p>Some words of a page that has no article at all.</p></div>"), "Head line\nSome words of a page that has no article at all."),
    "empty": ("", ""),
    "null": (None, ""),
    "no words": (page("<article></article>"), ""),
}


@pytest.fixture(scope="module")
def weights(spark):
    rows = [(i, f"http://x/{i}", page(ARTICLE.replace("First", f"Word{i} " * 30))) for i in range(40)]
    return fit_weights(spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", CASES)
def test_main_text(weights, name):
    html, expected = CASES[name]
    assert main_text(html, weights) == expected


def test_region_is_the_best_contiguous_run():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        best = max([0] + [sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)])
        low, high = best_region(scores)
        assert sum(scores[low:high]) == best


def test_words_score_above_zero_and_tags_below(weights):
    features = {f for f, _, _ in page_items(page(ARTICLE))}
    assert all((weight_of(f, weights) > 0) == f.startswith("word ") for f in features)


def test_weights_need_no_labels(spark):
    frame = spark.createDataFrame([(1, "u", "<p>Only text here</p>")], "page_id long, url string, html string")
    assert extract_main_text(frame).first()["text"] == "Only text here"


def test_rows_nulls_repeats_and_clashing_columns(spark):
    long = page("<article>" + "<p>word and word</p>" * 20_000 + "</article>")
    rows = [(1, "u", CASES["plain"][0], "a"), (1, "u", CASES["plain"][0], "a"), (None, None, None, None), (3, "v", long, "b")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_main_text(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    n = len(CASES["plain"][1])
    got = sorted((r.page_id or 0, r.n_chars) for r in found.collect())
    assert got == [(0, 0), (1, n), (1, n), (3, 14 * 20_000 - 1)]
    assert extract_main_text(frame.limit(0)).count() == 0
