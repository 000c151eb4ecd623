"""URL parsing and rules against plain code, the tree on planted templates, and the SQL."""

import re
import time

import pytest

from pactframe.llm import url_templates as ut
from pactframe.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.llm.conftest import FOLDER


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = (None, None)
    for action, rule in ut.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and len(rule) > len(best[0] or ""):
            best = (rule, action)
    return host, path, *best


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.ORG/x?y=/z#q", "http://example.org/es/1", "http://www.example.org/en/12",
    "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com:80/de/1", "ftp://É.com/fr/",
    "http://a.org?x=://b.com/de/", "http://a.org#/es/", "http://x.com", "http://com/de/", "a://b://c.com/de/", "http://x.com/de", "http://x.com//de/",
]


def frame(spark, urls):
    return spark.createDataFrame([(n, u, "own") for n, u in enumerate(urls)], "page_id long, url string, verdict string")


def test_hosts_paths_and_rules(spark):
    out = ut.judge_urls(frame(spark, URLS))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "template", "purity", "verdict"]
    rows = out.collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, action = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == action if action else r.verdict in ("allow", "block")


@pytest.mark.parametrize("folder", [FOLDER])
def test_query_equals_sql(spark, folder):
    assert not differences(QUERIES["op4_url_filter"](spark, folder), connect(folder), ORACLES["op4_url_filter"])


def test_planted_templates(spark):
    """Pages /ads/<n>/... are bad and /news/... good on one host; unlabelled pages follow their template."""
    urls, labels = [], []
    for n in range(60):
        urls += [f"http://h.net/ads/{n}", f"http://h.net/news/{n}.html"]
        labels += [(2 * n, 1), (2 * n + 1, 0)]
    urls += ["http://h.net/ads/999", "http://h.net/news/999.html", "http://h.net/other/1", "http://k.net/ads/999"]
    bad = spark.createDataFrame([(i, b) for i, b in labels] + [(None, 1), (3, None)], "page_id long, bad int")
    rows = {r.url: r for r in ut.judge_urls(frame(spark, urls), labels=bad).collect()}
    assert rows["http://h.net/ads/999"].verdict == "block" and rows["http://h.net/ads/999"].template.startswith("/ads/")
    assert rows["http://h.net/news/999.html"].verdict == "allow"
    assert rows["http://h.net/other/1"].verdict == "allow" and rows["http://k.net/ads/999"].verdict == "allow"
    assert ut.allowed(frame(spark, urls), labels=bad).where("url like '%/ads/%'").count() == 1


def test_similar_branches_merge(spark):
    urls = [f"http://h.net/{a}/{n}" for a in ("a", "b", "c") for n in range(40)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(120)], "page_id long, bad int")
    assert {r.template for r in ut.judge_urls(frame(spark, urls), labels=labels).collect()} == {"/*/*/*"}


def test_repeated_rows_and_empty_table(spark):
    assert ut.judge_urls(frame(spark, ["http://x.com/de/1"] * 5)).count() == 5
    assert ut.judge_urls(frame(spark, [])).count() == 0


def test_branches_that_part_at_segment_five(spark):
    """The first four segments are the same; unlabelled pages follow the fifth, and paths of other hosts stay as they are."""
    urls, labels = [], []
    for n in range(60):
        urls += [f"http://h.net/a/b/c/d/ads/{n}", f"http://h.net/a/b/c/d/news/{n}.html", f"http://k.net/{'ads' if n % 2 else 'news'}/{n}"]
        labels += [(3 * n, 1), (3 * n + 1, 0), (3 * n + 2, n % 2)]
    urls += ["http://h.net/a/b/c/d/ads/x/999", "http://h.net/a/b/c/d/news/999.html", "http://h.net/a/b/c/", "http://h.net/a/b/c/d/ads/777/"]
    bad = spark.createDataFrame(labels, "page_id long, bad int")
    rows = {r.url: r for r in ut.judge_urls(frame(spark, urls), labels=bad).collect()}
    assert len(rows) == len(urls)
    for url, r in rows.items():
        if "h.net" in url:
            assert r.verdict == ("block" if "/ads/" in url else "allow"), r
    assert rows["http://h.net/a/b/c/d/ads/777/"].template.split("/")[5] == "ads"
    shallow = [u if "k.net" in u else f"http://h.net/{u.split('/')[-2]}" for u in urls]
    alone = {r.url: r for r in ut.judge_urls(frame(spark, shallow), labels=bad).collect()}
    for url in urls:
        if "k.net" in url:
            assert (alone[url].template, alone[url].purity) == (rows[url].template, rows[url].purity)


def judged(spark, pages, unknown):
    """Verdicts of ``unknown`` URLs beside ``pages`` (url, bad), by URL."""
    urls = [u for u, _ in pages] + unknown
    labels = spark.createDataFrame([(n, b) for n, (_, b) in enumerate(pages)], "page_id long, bad int")
    rows = ut.judge_urls(frame(spark, urls), labels=labels).collect()
    assert len(rows) == len(urls)
    return {r.url: r for r in rows}


def test_a_thousand_segments(spark):
    """Paths of a thousand segments that part at the last but one; the time does not follow the depth."""
    deep = "/".join(f"d{chr(97 + n % 26)}" for n in range(998))
    pages = [(f"http://h.net/{deep}/{kind}/{n}", int(kind == "ads")) for n in range(20) for kind in ("ads", "news")]
    unknown = [f"http://h.net/{deep}/{kind}/999" for kind in ("ads", "news")] + ["http://k.net/" + "x/" * 5000]
    start = time.time()
    rows = judged(spark, pages, unknown)
    assert time.time() - start < 120
    assert [rows[u].verdict for u in unknown] == ["block", "allow", "allow"]
    assert rows[unknown[0]].template.split("/")[999:] == ["ads", "*"] and set(rows[unknown[0]].template.split("/")[4:999]) == {"*"}


def test_deep_segments_below_wildcards_and_by_parent(spark):
    """ads and news part below ever new names; old is bad below p and good below q, new the other way round."""
    pages = [(f"http://h.net/a/b/c/{name}/{kind}/{n}", int(kind == "ads"))
             for name in ("u", "v", "w", "x", "y", "z") for kind in ("ads", "news") for n in range(3)]
    pages += [(f"http://g.net/a/b/c/{up}/{kind}/{n}/{m}", int((up == "p") == (kind == "old")))
              for up in ("p", "q") for kind in ("old", "new") for n in range(20) for m in (n, n + 1)]
    # more pages of one parent, so that the parents themselves differ and stay apart
    pages += [(f"http://g.net/a/b/c/p/old/{n}/x{n}x", 1) for n in range(60)]
    unknown = ["http://h.net/a/b/c/never/ads/1", "http://h.net/a/b/c/never/news/1"]
    unknown += [f"http://g.net/a/b/c/{up}/{kind}/777/1" for up in ("p", "q") for kind in ("old", "new")]
    rows = judged(spark, pages, unknown)
    assert [rows[u].verdict for u in unknown] == ["block", "allow", "block", "allow", "allow", "block"]
