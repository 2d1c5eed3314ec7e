"""Main text of pages: parsing, gradients, held-out pages, and the whole table."""

import time

import numpy as np
import pytest

from textguard.llm import html_text, queries
from textguard.llm.html_samples import sample_pages


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def found(page):
    return [(" ".join(path), text) for path, text, _ in html_text.blocks(page)]


def test_blocks():
    page = (
        '<html><head><title>T &amp; t</title><script>var t="</p><p>no";</script></head><body>'
        '<div class="topBar-main" id=x>a &lt;b&gt;&nbsp; c<br>d</div><!-- <p>no</p> --><article><p>one <b>two'
        "<p>three</i></b><ul><li>x<li>y</ul><a href='/q'>link</a> 2 < 3 & 4 &eacute;&#233;&copy z</article>tail"
    )
    assert found(page) == [
        ("html head title", "T & t"),
        ("html body div .top .bar .main .x", "a <b> c d"),
        ("html body article p b", "one two"),
        ("html body article p", "three"),
        ("html body article ul li", "x"),
        ("html body article ul li", "y"),
        ("html body article", "link 2 < 3 & 4 éé© z"),
        ("html body", "tail"),
    ]
    for broken in ("", "<", "<p", "<p class='", "</", "<!--", "a<b", "<script>x", "&#x;", "<<<>>>", "<p>" * 3000 + "x"):
        list(html_text.blocks(broken))


def test_stray_quotes():
    page = '<p><a href="x"">First words</a> on.</p><p>Whole paragraph.</p><p><a href="y"">Last</a></p>'
    assert [t for _, t in found(page)] == ["First words on.", "Whole paragraph.", "Last"]
    assert [t for _, t in found('<p><a href="x"">Only</a></p>')] == ["Only"]
    assert [t for _, t in found("<p title = 'a > b' it's>one</p><p q=/s?a=\"b>two</p><p>\"three\"</p>")] == ["one", "two", '"three"']
    list(html_text.blocks("<p " + 'a="x" ' * 20_000))


def test_hostile_pages_take_linear_time():
    for unit in ("<a", "a<b ", "<div>x", '<x y="', "</", "<a ", "<b><div>x</b>", "<!--", "<script>", "<li>a<b"):
        for tail in ("", ">", 'b=">"'):
            page = unit * (1_000_000 // len(unit)) + tail
            start = time.perf_counter()
            for _ in html_text._leaves(page):
                pass
            assert time.perf_counter() - start < 10, (unit, tail)  # seconds a MB; it was hours
    start = time.perf_counter()
    html_text.encoded("".join(f"<div class=c{i}>x" for i in range(20_000)))
    assert time.perf_counter() - start < 20


def test_tags_that_do_not_end():
    assert found('a <b href="x') == [("", "a")] and found("1 < 2 <3") == [("", "1 < 2 <3")]
    assert found('<p>one</p><q <q <q b=">" c') == [("p", "one"), ("", '<q b=">" c')]
    assert found('<p>x <a b="> y" </p>') == [("p a", "x")]


def test_gradient():
    model = html_text.Labeller.fresh(3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    group = []
    for page, main in sample_pages(4, 3):
        rows, texts = html_text.encoded(page)
        group.append((rows, np.array([t in main for t in texts], float)))

    def loss():
        x, there = model.padded([rows for rows, _ in group])
        p = model.forward(x.astype(np.float64), there)[0]
        parts = [np.log(np.where(y == 1, p[: len(y), i], 1 - p[: len(y), i])) for i, (_, y) in enumerate(group)]
        return -np.concatenate(parts).mean()

    slopes = html_text._gradient(model, group)
    rng = np.random.default_rng(1)
    for name, value in model.weights.items():
        at = tuple(rng.integers(s) for s in value.shape) if name not in ("paths", "words") else tuple(
            int(i) for i in np.unravel_index(np.abs(slopes[name]).argmax(), value.shape)
        )
        was = value[at]
        value[at] = was + 1e-3
        up = loss()
        value[at] = was - 1e-3
        down = loss()
        value[at] = was
        assert slopes[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name


def test_held_out_pages(model):
    pages = sample_pages(1234, 200)
    rows, texts = zip(*(html_text.encoded(p) for p, _ in pages))
    wrong = total = 0
    for (_, main), t, p in zip(pages, texts, model.probabilities(list(rows))):
        wrong += sum((text in main) != (chance >= 0.5) for text, chance in zip(t, p))
        total += len(t)
    assert wrong < 0.005 * total


def test_edge_rows(spark, model):
    long = "<body><nav><a>x</a></nav><article>" + "<p>some words of text here.</p>" * 20_000 + "</article>"
    rows = [(1, None), (2, ""), (3, "  "), (4, "<nav><ul><li><a>menu</a></li></ul></nav>"), (5, long), (5, long), (None, "<p>")]
    pages = spark.createDataFrame([(*r, "a") for r in rows], "page_id long, html string, TEXT string")
    got = html_text.main_text(pages, model)
    assert got.columns == ["page_id", "html", "text"]
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts.pop(5) == "\n\n".join(["some words of text here."] * 20_000)
    assert set(texts.values()) == {""}
    assert html_text.main_text(pages.limit(0), model).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.op5_html_text(spark, folder).collect()
    assert len(got) == len(pages)
    for row in got:
        want = [t for path, t, _ in html_text.blocks(pages[row.page_id].html) if "article" in path]
        assert row.text == "\n\n".join(want) and row.n_chars == len(row.text)
        assert row.url == pages[row.page_id].url
