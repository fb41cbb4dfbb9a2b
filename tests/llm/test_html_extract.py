from __future__ import annotations

import math
import random
import re

import numpy as np

from shroudspark.llm.html_extract import Lines, Plan, content_lines, extract, extract_page, smooth

LONG = "A sentence of the article that goes on for a while, as they do, and then ends at last. " * 3
PAGE = (
    "<!DOCTYPE html><html><head><title>The &amp; title</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul>" + "".join(f'<li><a href="/{k}">nav{k}</a></li>' for k in range(8)) + "</ul></nav><!-- note -->"
    f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}<b>bold</b></p></article>"
    "<ul>" + "".join(f'<li><a href="#">foot{k}</a></li>' for k in range(8)) + "</ul></body></html>"
)


def test_content_is_kept_and_links_go():
    title, content, n, kept = extract_page(PAGE, Plan())
    assert title == "The & title"
    assert content.count("A sentence") == 6 and "Short." in content and "bold" in content
    assert "nav0" not in content and "foot7" not in content and "var t" not in content and "note" not in content
    assert n == 20 and kept == len(content.split("\n"))


def test_smoothing_keeps_constants_and_sums_kernels():
    assert np.allclose(smooth(np.full(7, 3.0), 1.0), 3.0)
    assert np.allclose(smooth(np.array([5.0]), 2.0), 5.0)
    got = smooth(np.array([0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), 0.5)
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / 0.5) ** 2)
    assert np.isclose(got[3], kernel[2] / kernel.sum()) and got.argmax() == 3


def test_threshold_against_brute_force():
    lines = [("x" * n, t) for n, t in [(5, 3), (200, 1), (3, 1), (180, 2), (4, 4), (4, 4), (2, 4), (1, 5)]]
    plan = Plan(gap=0)
    ratio = [len(t) / max(k, 1) for t, k in lines]
    weight = lambda a, b: np.exp(-0.5 * (a - b) ** 2) if abs(a - b) <= 3 else 0
    smoothed = [sum(weight(a, b) * r for b, r in enumerate(ratio)) / sum(weight(a, b) for b in range(len(ratio))) for a in range(len(ratio))]
    assert content_lines(lines, plan).tolist() == [s >= 0.5 * np.std(smoothed) and s > 0 for s in smoothed]


def test_broken_markup_is_read_as_far_as_it_goes():
    parser = Lines()
    parser.feed("<p>one<div>two</b></i><p>three &eacute; &bogus; <script>hidden")
    parser.close()
    assert [t for t, _ in parser.lines if t] == ["one", "two", "three é &bogus;"]


def test_cases(spark):
    big = "<p>" + "word " * 100_000 + "</p>"
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "plain text alone"), (5, "u", big), (1, "u", PAGE), (None, "u", "<p>x")]
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id bigint, url string, html string, title string, content int")
    got = {}
    for r in extract(pages).collect():
        got.setdefault(r["page_id"], []).append((r["title"], r["content"], r["n_lines"], r["n_content"]))
    assert got[2] == [(None, None, 0, 0)] and got[3] == [(None, "", 0, 0)]
    assert got[4] == [(None, "plain text alone", 1, 1)]
    assert len(got[5][0][1]) == 499_999
    assert got[1][0] == got[1][1] == extract_page(PAGE, Plan())
    assert extract(pages.limit(0)).count() == 0


def shown(html):
    parser = Lines()
    parser.feed(html)
    parser.close()
    return [t for t, _ in parser.lines if t]


def test_elements_that_nothing_ends_hide_nothing():
    assert shown("<p>a<svg><text>t</text></svg>b<p>c") == ["ab", "c"]
    assert shown("<p>a<svg><path><p>b</p><p>c") == ["a", "b", "c"]
    assert shown("<p>a<math><mi>x<div>b</div>c") == ["a", "b", "c"]
    for tag in ("noscript", "template"):
        assert shown(f"<p>a<{tag}>b<p>c</p></{tag}>d<p>e") == ["ad", "e"]
        assert shown(f"<p>a</p><{tag}><p>b</p><p>c") == ["a", "b", "c"]
        assert shown(f"<p>a</p><{tag}><script>x</script><p>b") == ["a", "b"]
    assert shown("<p>a<svg><foreignObject><div>x</div></foreignObject></svg>b") == ["ab"]
    assert extract_page("<svg><title>icon</title></svg><title>page</title><p>x", Plan())[0] == "page"


def test_pages_equal_brute_force(spark):
    """Random pages of simple markup, taken apart by a pattern and smoothed by plain loops."""
    rng = random.Random(5)
    word = lambda: rng.choice(("alpha", "be", "gamma delta", "x", "&amp;"))
    block = lambda: rng.choice(("p", "div", "li", "h2", "td"))

    def page():
        out = []
        for _ in range(rng.randrange(1, 30)):
            tag, body = block(), " ".join(word() for _ in range(rng.choice((0, 2, 3, 40))))
            links = "".join(f"<a href='{word()}'>{word()}</a> " for _ in range(rng.choice((0, 0, 6))))
            out.append(rng.choice((f"<{tag}>{body} {links}</{tag}>", f"<{tag}>{links}<br/>{body}", "<script>var a='<p>';</script>", f"<!-- {body} -->{body}")))
        return "\n".join(out)

    def naive(html):
        lines, text, tags = [], "", 0
        html = re.sub(r"(?s)<script>.*?</script>|<!--.*?-->", lambda m: "\x00" if m[0].startswith("<script") else "", html)
        for part in re.findall(r"<[^>]*>|[^<]+", html):
            if part[0] != "<":
                text += part.replace("\x00", "").replace("&amp;", "&")
                continue
            name, end = re.match(r"</?(\w+)", part)[1], part[1] == "/"
            wide = name in ("p", "div", "li", "h2", "td", "br")
            if wide and not end:
                lines.append((" ".join(text.split()), tags))
                text, tags = "", 0
            tags += 1
            if wide and end:
                lines.append((" ".join(text.split()), tags))
                text, tags = "", 0
        lines = [(t, n) for t, n in [*lines, (" ".join(text.split()), tags)] if t or n]
        ratio = [len(t) / max(n, 1) for t, n in lines]
        near = [[(b, math.exp(-0.5 * (a - b) ** 2)) for b in range(max(0, a - 3), min(len(ratio), a + 4))] for a in range(len(ratio))]
        smoothed = [sum(w * ratio[b] for b, w in row) / sum(w for _, w in row) for row in near]
        mean = sum(smoothed) / max(len(smoothed), 1)
        bound = 0.5 * math.sqrt(sum((s - mean) ** 2 for s in smoothed) / max(len(smoothed), 1))
        kept = [s >= bound and s > 0 for s in smoothed]
        for a in range(1, len(kept) - 1):
            kept[a] = kept[a] or smoothed[a - 1] >= bound and smoothed[a - 1] > 0 and smoothed[a + 1] >= bound and smoothed[a + 1] > 0
        return "\n".join(t for (t, _), k in zip(lines, kept) if k and t), sum(bool(t) for t, _ in lines)

    pages = [(k, page()) for k in range(60)]
    got = {r["page_id"]: (r["content"], r["n_lines"]) for r in extract(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert got == {k: naive(html) for k, html in pages}
