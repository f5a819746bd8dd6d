"""Page extraction and URL rules against brute force and fixed pages."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from tidemark.llm import html_extract, url_filter
from tidemark.llm.queries import op2_html_extract, op7_url_filter

PAGE = (
    "<html><head><title>T</title><script>var t='</p>';</script></head><body><div class=header><h1>Site</h1></div><nav><a>Home</a></nav><main><h2>T</h2>"
    "<p>A&nbsp;b &lt;c&gt; <b>bold</b>x<br>y<aside>no</aside><form><p>no</p></form><ul><li>i1<li>i2</ul><!-- <p>no</p> -->"
    '<section class="comments"><article><p>nope</p></article></section></main><div id="cookie-notice">n</div><footer>f</footer></body>'
)


def test_structure():
    assert html_extract.text_of(html_extract.lines_of(PAGE), set()) == "T\n\nA b <c> boldx y\n\ni1\n\ni2"


@pytest.mark.parametrize("page", ["", "<", "plain &amp; text", "<p>a<p>b", "<div class=ad>open <article><p>in</p></article>", "<p title='x>y'>q</p>", "<b>" * 3000 + "x", "<div>" * 3000 + "x", "<!-- never closed", "<script>never closed"])
def test_broken_pages_have_a_text(page):
    text = html_extract.text_of(html_extract.lines_of(page), set())
    assert ("in" in text) == ("<article>" in page) or "<article>" not in page
    assert "<p" not in text


def plain_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_longest(rng):
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        left, right = html_extract.common_lines(a, b)
        assert len(left) == len(right) == plain_length(a, b) and [a[i] for i in sorted(left)] == [b[i] for i in sorted(right)]


def test_common_lines_of_huge_pages(monkeypatch, rng):
    monkeypatch.setattr(html_extract, "CELLS", 4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 20))] for _ in range(2))
        left, right = html_extract.common_lines(a, b)
        assert len(left) == len(right) == plain_length(a, b) and [a[i] for i in sorted(left)] == [b[i] for i in sorted(right)]


def test_what_an_article_holds_is_text():
    page = '<article><div class="search-results"><p>a</p></div><div class="related">b</div><math><mi>x</mi></math><p title="' + "v" * 5000 + '>">c</p><div class="comments">no</div></article>'
    assert html_extract.text_of(html_extract.lines_of(page), set()) == "a\n\nb\n\nx\n\nc"


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</span>" * 50_000, "<b class=ad>" * 30_000, '<a "' * 20_000, "<!" * 50_000, "<script>" * 20_000, "<article><p>" + "word " * 200_000 + "</article>"])
def test_long_pages_take_no_time(page):
    began = time.perf_counter()
    html_extract.lines_of(page)
    assert time.perf_counter() - began < 5


def test_ranges_do_not_change_a_result(spark):
    rows = [(k, f"http://h{k % 3}.example/a/{k:03}", f"<div>Menu {k % 3}</div><div>Own {k}</div>") for k in range(60)] + [(5, None, "<p>x"), (None, "http://h1.example/a/010", "<div>Menu 1</div><div>y</div>"), (None, None, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, text string").repartition(4)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted(map(tuple, html_extract.extract(df).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert all(r[2] == f"Own {r[0]}" for r in found[0] if r[2].startswith("Own"))
    assert html_extract.extract(df.limit(0)).count() == 0


def test_neighbours_lose_what_they_share(spark):
    rows = [(k, f"http://h.example/a/{k}", f"<body><div>Menu of the site</div><div>Story number {k}</div><div>All rights</div></body>") for k in range(5)]
    rows += [(9, None, None), (10, "http://h.example/z", ""), (11, "http://alone.example/", "<div>Menu of the site</div><div>x</div>"), (0, rows[0][1], rows[0][2])]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    by_page = {r["page_id"]: r["text"] for r in found.collect()}
    assert by_page[3] == "Story number 3" and by_page[9] == by_page[10] == "" and by_page[11] == "Menu of the site\n\nx" and found.count() == 9


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", inside))).split("\0")
    return "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_whole_table(spark, data):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = op2_html_extract(spark, data).collect()
    assert len(found) == len(pages) and all(r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in found)


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.action


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "http://example.net/de/80", "http://a.example.net/de/9", "http://xcom/en/", "ftp://com/en/1", "http://org#a/es/", "http://b.org/es/1://c", "x://İ.org/es/", "http://free-bets-now.example/odds"]


def test_rules(spark, data):
    rows = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_filter.judge(rows, "page_id").collect():
        host, path, rule, action = plain_verdict(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (action is None or r["verdict"] == action)
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = op7_url_filter(spark, data).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path, rule, action = plain_verdict(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (action or ("block" if r["probability"] >= 0.5 else "allow"))
    assert url_filter.judge(rows.limit(0), "page_id").count() == 0


#: The contract's rules, as it lists them.
CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_those_of_the_contract(spark):
    assert sorted((r.action, r.host + r.path) for r in url_filter.RULES) == sorted(tuple(r.split()) for r in CONTRACT.split(", "))
    wanted = {"x.com/en/1": "block", "a.example.com/en/70": "allow", "x.net/de/": "allow", "example.net/de/7": "allow", "a.example.net/de/8": "block", "org/es/": "block"}
    rows = spark.createDataFrame([(u, f"http://{u}?q") for u in wanted], "page_id string, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(rows, "page_id").collect()} == wanted


def test_model_on_rows_left_out():
    rows = url_filter.labelled()
    random.Random(2).shuffle(rows)
    right = 0
    for k in range(5):
        model = url_filter.train([r for i, r in enumerate(rows) if i % 5 != k])
        rest = [r for i, r in enumerate(rows) if i % 5 == k]
        right += sum((p >= 0.5) == bool(r[2]) for p, r in zip(model.probability([r[0] for r in rest], [r[1] for r in rest]), rest, strict=True))
    assert right / len(rows) > 0.75
