"""Collocations, main texts and spelling variants, against brute force and on awkward rows."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import database, difference
from visledger.llm import collocations, html_extract, queries, spelling

from .brute_collocations import brute
from .data import documents, empty

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_collocations", "op13_spelling"])
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), database(SF), queries.SQL[name]) == ""


def _words(rng, n):
    return " ".join(rng.choice(["new", "york", "city", "The", "of", "état", "ÀB", "x1", "a.", "b,c", "d\te", "f\n\ng"]) for _ in range(n))


def test_automaton_counts_every_substring():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 4):
        words = rng.integers(0, 5, 300).astype(np.int32)
        words[words == 1] = 0
        found = collocations.automaton(words, depth)
        assert (found.link < found.length).all()
        for k in range(1, depth + 1):
            want = Counter(tuple(words[i - k + 1 : i + 1]) for i in range(k - 1, 300) if (words[i - k + 1 : i + 1] > 1).all())
            ends, n = collocations.substrings(found, k)
            got = {tuple(words[e - k + 1 : e + 1]): c for e, c in zip(ends.tolist(), n.tolist())}
            assert len(got) == len(ends) and got == want


@pytest.mark.parametrize("shard", [40, 1 << 21])
@pytest.mark.parametrize("depth", [2, 3, 4])
def test_collocations_equal_brute_force(spark, monkeypatch, shard, depth):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "_SLICE", 64)
    rng = random.Random(shard + depth)
    rows = [(i, None if i % 11 == 0 else _words(rng, rng.randint(0, 60)), ["en", None, "und", "de"][i % 4], "a") for i in range(60)]
    got = [tuple(r) for r in collocations.mine(documents(spark, rows).repartition(3), depth=depth).collect()]
    assert sorted(got) == sorted(brute([(t, g) for _, t, g, _ in rows], depth)) and got


def test_collocations_of_small_filters_and_ties(spark, monkeypatch):
    rows = [(i, "a b a b a b; c d", "en", "a") for i in range(10)] + [(99, "q " * 5000 + "z", "fr", None)]
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(collocations, "FILTER_BITS", 1)
    got = [tuple(r) for r in collocations.mine(documents(spark, rows), top=2).collect()]
    assert sorted(got) == sorted(brute([(t, g) for _, t, g, _ in rows], top=2))


def test_collocations_of_nothing(spark):
    assert collocations.mine(empty(documents(spark))).collect() == []
    assert collocations.mine(documents(spark, [(1, None, "en", "a"), (2, "", None, None), (3, "once only", "en", "a")])).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>no {k}</title><style>p{{}}</style><script>var x = "</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>no site</h1></header><nav><ul><li><a href="/a">no</a></li></ul></nav>
<div class="cookie-notice">no cookies</div><!-- no <p>no</p> -->
<div id="wrap"><article class="post-{k}"><header><h1>Title {k} &amp; more</h1></header>{body}
<form action="/x"><p>no form</p></form><div class="ad-box">no ad</div><section id="comments"><p>no comment {k}</p></section></article>
<aside>no aside</aside></div><footer>no footer &copy;</footer></body></html>"""


def test_pages_with_furniture(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(60):
        parts = [rng.choice([f"<p>one <b>bold</b>ed &lt;{k}&gt;\n  two", "<h2>head</h2><p>under it</p>", "<ul><li>x<li>y</ul>", f"<p>line<br>break {k}</p>", "<blockquote><p>said</p></blockquote>"]) for _ in range(rng.randint(1, 30))]
        rows.append((k, f"http://H{k % 3}.example.com/{k}", PAGE.format(k=k, body="".join(parts))))
        said = " ".join(" ".join(parts).split())
        said = html.unescape(re.sub(r"<b>|</b>", "", said).replace("<br>", " "))
        want[k] = " ".join(re.sub(r"</?(?:p|h2|ul|li|blockquote)>", " ", re.sub(r"<b>|</b>", "", " ".join(parts)).replace("<br>", " ")).split())
        want[k] = f"Title {k} & more " + html.unescape(want[k])
    rows += [(100, None, None), (101, "no scheme", ""), (102, "http://h0.example.com/", "<p>only <i>this"), (None, "http://h1.example.com/", rows[1][2]), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(c) for c in ("host", "text", "rule", "t")}).repartition(5)
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = want[1] if r["page_id"] is None else want.get(r["page_id"], {102: "only this"}.get(r["page_id"], ""))
        assert (r["text"], r["n_chars"]) == (expected, len(expected))
    assert html_extract.extract(empty(pages)).collect() == []


def test_template_and_menus_of_a_host_without_regions(spark):
    page = "<body><div class=top>Our site</div><div class=links><a href=/1>one</a> <a href=/2>two</a></div><div class=text><p>{a}</p><p>{b}</p></div><div class=end>All rights reserved</div></body>"
    rows = [(k, "https://plain.example.org/x", page.format(a=f"words of {k}", b=f"more {k} words")) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"words of {k} more {k} words" for k in range(12)}
    same = [(k, "https://copies.example.org/x", rows[0][2]) for k in range(12)]  # copies alone show no template
    got = {r["text"] for r in html_extract.extract(spark.createDataFrame(same, "page_id bigint, url string, html string")).collect()}
    assert got == {"Our site words of 0 more 0 words All rights reserved"}


def test_wrappers_are_union_free_and_bounded(monkeypatch):
    a = html_extract.page_wrapper("<article><h1>t</h1><p>a</p><p>b</p></article>")
    b = html_extract.page_wrapper("<article><p>c</p><aside>x</aside></article>")
    assert html_extract.merge(a, b).pattern() == "<><article>(<h1>#</h1>)? (<p>#</p>)+ (!aside)?</article></>"
    pairs = html_extract.page_wrapper("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>")
    assert pairs.pattern() == "<><dl>(<dt>#</dt> <dd>#</dd>)+</dl></>"
    rng = random.Random(1)
    merged = a
    for k in range(300):
        body = "".join(f"<{t} class='{''.join(rng.choices('abcdefgh', k=4))}'>x</{t}>" for t in rng.choices(["p", "ul", "table", "h2", f"z{rng.randint(0, 9)}y", "div"], k=rng.randint(1, 80)))
        merged = html_extract.merge(merged, html_extract.page_wrapper(f"<article>{body}</article>"))
        assert html_extract._size(merged) <= html_extract.MOST_NODES
    assert merged.n == 301 and html_extract.Slot.of_list(merged.to_list()).to_list() == merged.to_list()


def test_markup_that_is_broken_or_deep():
    none = ["", "", []]
    assert html_extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000, none) == "deep"
    assert html_extract.main_text("a <b", none) == "a" and html_extract.main_text("1 < 2 <!-- x", none) == "1 < 2"
    assert html_extract.main_text('<p title="x>y">q</p><a href="', none) == "q"
    assert html_extract.main_text("<p><b>a</b> <i>b</i>c<head> <title>t</title>", none) == "a bc"
    assert html_extract.main_text("<script>never closed <p>x</p>", none) == ""
    assert html_extract.main_text("<p>&nbsp;a&#32;&#x62;&bogus; &amp;lt;", none) == "a b&bogus; &lt;"
    assert html_extract.main_text("<" * 20000 + 'x <a "' * 5000, none).startswith("<<<")


def _brute_spelling(rows):
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    out, form = {}, {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(others)

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("bucket", [0, 3, 64])
def test_spelling_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "PLAIN_BUCKET", bucket)
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    monkeypatch.setattr(spelling, "_SLICE", 100)
    rng = random.Random(7)
    base = ["received", "straßes", "ÀÉÎõüý", "aaaaaaa", "listenx", "silentx", "abcabcabc"]

    def variant(w):
        k, c = rng.randrange(len(w)), rng.choice("abcxéÿ")
        return rng.choice([w, w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], "".join(rng.sample(w, len(w)))])

    pool = [variant(variant(w)) for w in base for _ in range(25)] + base
    rows = [(None if i % 17 == 0 else i // 2, None if i % 23 == 0 else " 1".join(rng.choices(pool, k=60)).replace("1", rng.choice([" ", "1", "×", "—"]))) for i in range(90)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = {tuple(r) for r in spelling.group(spelling.count_words(docs)).collect()}
    assert got == _brute_spelling(rows) and any(f for _, f, *_ in got)


def test_forms_lead_on_to_a_root(spark):
    steps = [("kettle" + "s" * k, 5 ** (k + 1)) for k in range(9)]
    got = {r["word"]: r["root"] for r in spelling.group(spark.createDataFrame(steps, "word string, n bigint")).collect()}
    assert set(got.values()) == {steps[-1][0]}
    assert spelling.group(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_many_orders_of_the_same_letters(spark):
    rng = random.Random(3)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(3000)} | {"".join(rng.sample("abcdefg", 7)) for _ in range(500)}
    pairs = {(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = {tuple(sorted((w, w[:k] + w[k + 1 :]))) for w in words for k in range(len(w)) if w[:k] + w[k + 1 :] in words}
    assert pairs == want and want
