"""Blocks of odd markup, gradients, held-out accuracy, and the query against the pages' own markup."""

import html
import re
from collections import Counter

import numpy as np
import pytest

from pactframe.llm import html_blocks as hb
from pactframe.llm.queries import QUERIES
from tests.llm.conftest import FOLDER, rows_of


def plain_article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    body = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))
    return " ".join(html.unescape(body).split())


def test_query(spark):
    want = {i: (u, plain_article(h)) for i, u, h in rows_of("pages")}
    rows = QUERIES["op6_main_text"](spark, FOLDER).collect()
    assert len(rows) == len(want)
    right = 0
    for r in rows:
        assert r.url == want[r.page_id][0] and r.n_chars == len(r.text)
        right += r.text == want[r.page_id][1]
    assert right >= 0.99 * len(rows)


def texts(page):
    return [b.text for b in hb.blocks(page)]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain", ["plain"]), ("<p>a<b>b</b>c<br>d", ["abc", "d"]), ("<p>one<p>two</div>three", ["one", "two", "three"]),
    ("a &amp; b&nbsp;c &#233; &xyzzy;", ["a & b c é &xyzzy;"]), ("<script>x<p>y</script>z<style>q", ["z"]),
    ("<!-- <p>no</p> -->yes<!-- open", ["yes"]), ("1 < 2 and <b>3 > 2</b>", ["1 < 2 and 3 > 2"]), ("<a title='a>b'>link</a>", ["link"]),
    ("<td>x</td><td>y</td>", ["x", "y"]), ("<P CLASS=Ad>up</P>", ["up"]), ("<p", ["<p"]), ("<div><span>in</span>line</div>", ["inline"]),
    ("<textarea>t</textarea><option>o1<option>o2", ["t", "o1", "o2"]), ("<svg><text>s</text></svg>after", ["after"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    (block,) = hb.blocks('<main><div class="postBody big" id=x><p>see <a href=q>this link</a></p></div></main>')
    assert block.path == (("main", ()), ("div", ("post", "body", "big", "x")), ("p", ()))
    assert 0.5 < block.linked < 1


def test_long_and_hostile_pages_are_linear():
    for page in ("<p>" * 100_000, "<" * 300_000, "<a b='" * 50_000, "</p>" * 100_000, "x" * 1_000_000, "<p>w " * 20_000, "&" * 100_000):
        hb.blocks(page)


def test_gradients_are_the_derivatives():
    rng = np.random.default_rng(0)
    pages = ["<p>one two</p><div class=ad>three</div><li>four", "<h1>five</h1><p>six"]
    reader = hb.Reader()
    sequences = [reader.sequence(hb.blocks(p)) for p in pages]
    labels = [np.array([1.0, 0.0, 1.0]), np.array([0.0, 1.0])]
    net = hb.fresh()

    def loss():
        score, (_, _, place, mask, *_) = hb.forward(net, sequences)
        wanted = np.concatenate(labels)[place]
        return float((-(wanted * np.log(score) + (1 - wanted) * np.log(1 - score)) * mask).sum() / mask.sum())

    grad = hb.gradients(net, sequences, labels)
    for name, g in grad.items():
        places = np.argwhere(np.abs(g) > 1e-9)
        for at in places[rng.choice(len(places), min(4, len(places)), replace=False)]:
            at = tuple(at)
            old = net[name][at]
            net[name][at] = old + 1e-5
            up = loss()
            net[name][at] = old - 1e-5
            down = loss()
            net[name][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), (name, at)


@pytest.fixture(scope="module")
def net(spark):
    return hb.fit(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_held_out_accuracy(net):
    pages = [h for (h,) in rows_of("pages", "html")][:60]
    right = total = 0
    for sequence, labels in hb.examples_of(pages, seed=99):
        score = hb.forward(net, [sequence])[0][:, 0]
        right += int(((score >= 0.5) == labels).sum())
        total += len(labels)
    assert right >= 0.985 * total


def test_a_page_of_another_kind(net):
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
    <nav><ul><li><a href=x>Home</a></li></ul></nav><main><article><h1>Real title</h1><p>First &amp; more<b>bold</b>.</p>
    <aside class="related">See also</aside><p>Second<br>line</p><form><label>Mail</label><input></form></article>
    <section id="comments"><div class="comment"><p>Nice post!</p></div></section></main>
    <div class="sidebar"><p>Words beside the text.</p></div><div class="advert">Buy</div><footer>(c)</footer></body></html>"""
    assert hb.main_texts(net, hb.Reader(), [page]) == ["Real title First & morebold. Second line"]


def test_edges(spark, net):
    rows = [(1, None), (2, ""), (3, "<p>only text, which is long enough to be one"), (None, "<article><p>no key here</p></article>"), (4, "<p>x</p>"), (4, "<p>x</p>"),
            (5, "<article>" + "<p>long paragraph of words</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, html string, Text string")
    out = hb.extract(pages, net=net)
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, 2))
    assert next(r for r in got if r.page_id == 5).text == " ".join(["long paragraph of words"] * 3000)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    assert hb.extract(pages).count() == 0


@pytest.mark.parametrize("odd", ["<svg/>", "<svg />", "<iframe src=x>", "<iframe/>", "<object-card>", "<object data='a'>", "<canvas>", '<script src="a.js"/>',
                                 "<svg><text>no</text></svg>", "<STYLE>p { }</style >", "<noscript>", "<template-part>", "<script>if (a < b) '<p>no</p>'</script>"])
def test_unseen_elements_end_where_they_should(odd):
    assert [p.text for p in hb.blocks(f"<p>one</p>{odd}<p>two</p>")] == ["one", "two"]


def test_unclosed_script_hides_the_rest():
    assert [p.text for p in hb.blocks("<p>one</p><script>var a = '<p>two</p>'")] == ["one"]


def test_many_unclosed_elements_are_read_in_linear_time():
    assert len(hb.blocks("<p>a<iframe x></p>" * 30_000)) == 30_000


def test_long_page_beside_short_ones_in_bounded_memory():
    import resource

    net, page = hb.fresh(), "<p>some words of a block.</p>" * 100_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    hb.main_texts(net, hb.Reader(), [page] + ["<p>tiny</p>"] * 63)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_all_words_of_a_block_are_read():
    reader, text = hb.Reader(), " ".join(["edge"] * 64 + ["middle"] + ["edge"] * 64)
    assert hb.bucket("middle", hb.WORD_KINDS) in reader.word_ids(text)


# Pages of other layouts, labelled by hand: (is main text, block). No class name of theirs is in a word list of the module.
BY_HAND = [
    ("<div class=kopf><a href=/>Start</a> <a href=/n>News</a></div><div class=inhalt>{}</div><div class=fuss>Impressum</div>",
     ["The river rose by two metres during the night and flooded the lower streets of the old town.",
      "Volunteers carried sand bags to the bridge until the water fell again on Sunday."]),
    ("<table><tr><td><ul><li><a href=1>Home</a><li><a href=2>Shop</a></ul></td><td class=c2>{}</td></tr></table><p class=z9>Copyright 2020</p>",
     ["Bread dough needs time, and a cool night in the cellar gives it more taste than any spice.",
      "Bake it on a hot stone until the crust is dark and sounds hollow when it is tapped."]),
    ("<section class=q1><form><input name=s><button>Go</button></form></section><section class=q2>{}</section>",
     ["The committee read the report twice before it asked the authors for the missing tables.",
      "Two of the tables showed that the earlier counts had left out the northern villages."]),
]


def by_hand():
    for frame, paragraphs in BY_HAND:
        yield frame.format("".join(f"<p>{p}</p>" for p in paragraphs)), " ".join(paragraphs)


def test_pages_labelled_by_hand(spark, net):
    pages = spark.createDataFrame([(n, "u", h) for n, (h, _) in enumerate(by_hand())], "page_id long, url string, html string")
    read = {r.page_id: r.text.split() for r in hb.extract(pages, net=net).collect()}
    hits = found = wanted = 0
    for n, (_, text) in enumerate(by_hand()):
        words = text.split()
        hits += sum((Counter(words) & Counter(read[n])).values())
        found += len(read[n])
        wanted += len(words)
    print(f"F1 by hand {2 * hits / (found + wanted):.3f} precision {hits / max(1, found):.3f} recall {hits / wanted:.3f}")
    assert 2 * hits / (found + wanted) >= 0.8
