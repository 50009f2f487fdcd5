import base64
import collections
import hashlib
import itertools
import math
import re
import textwrap
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coordspark.llm import chat, exact_topk, html_text, jaccard_join, licenses, mixing, packing, quality_classifier, quality_rules, warc
from coordspark.llm.queries import QUERIES, byte_bpe

SMALL = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations([i for i in sets if sets[i]], 2):
        k = len(sets[i] & sets[j])
        if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
            p, q = find(i), find(j)
            up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_jaccard_join"](spark, SMALL).collect()}
    assert got == brute_components({r["doc_id"]: r["text"] for r in rows("documents")})


def test_jaccard_join_chains_and_edges(spark):
    words = [f"w{k}" for k in range(60)]
    texts = {k: " ".join(words[k : k + 40]) for k in range(0, 20, 2)}  # each near the next, ends far apart
    texts |= {50: None, 51: "", 52: "a b", 53: "A  b", 54: "x " * 300}
    df = spark.createDataFrame([(k, t, "z") for k, t in texts.items()], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == brute_components(texts)
    assert jaccard_join.join(df.where("false")).count() == 0
    assert jaccard_join.join(df.select(F.lit(None).cast("long").alias("doc_id"), "text")).where("component_id is not null").count() == 0


def brute_links(rows_):
    """Other documents linked with each id; an id's texts are one document."""
    sets = [(i, s) for i, t in rows_ if i is not None and (s := brute_set(t))]
    near = {i: set() for i, _ in rows_ if i is not None}
    for (i, s), (j, t) in itertools.combinations(sets, 2):
        k = len(s & t)
        if i != j and 100 * k >= 75 * (len(s) + len(t) - k):
            near[i].add(j)
            near[j].add(i)
    return {i: len(n) for i, n in near.items()}


def brute_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def test_jaccard_join_links(spark):
    got = {r.doc_id: r.n_links for r in QUERIES["op1_jaccard_join"](spark, SMALL).collect()}
    assert got == brute_links([(r["doc_id"], r["text"]) for r in rows("documents")])


def near_copies():
    words = [f"w{k}" for k in range(60)]
    data = [(k, " ".join(words[k : k + 40])) for k in range(0, 20, 2)]
    data += [(100 + k, " ".join([*words[:50], f"x{k}"])) for k in range(30)]  # different near copies, each linked with all
    data += [(200 + k, " ".join([*words[:44], *(f"y{k}{j}" for j in range(1 + k))])) for k in range(20)]
    data += [(100, data[12][1]), (101, "a b c d e f g"), (300, "a b c d e f g"), (0, " ".join(words[20:])), (300, None), (301, ""), (None, words[3])]
    return [*data, *data[15:18], *((400 + k, data[11][1]) for k in range(3))]


def test_jaccard_join_links_of_groups(spark):
    data = near_copies()
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = jaccard_join.join(df).collect()
    assert len(out) == len(data) and {r.doc_id: r.n_links for r in out if r.doc_id is not None} == brute_links(data)
    assert [r.n_links for r in out if r.doc_id is None] == [None]
    assert jaccard_join.join(df.where("false")).count() == 0


def test_jaccard_link_counts_in_blocks(spark):
    data = list({t: (i, t) for i, t in near_copies() if i is not None and brute_set(t)}.values())
    data = [(k, t) for k, (_, t) in enumerate(data)]
    df = spark.createDataFrame(data, "id long, text string")
    classes = df.select(F.arrow_udf(jaccard_join._digests, "n long, digest binary, key long")("text").alias("s"), "id").select("s.digest", "id", "s.n", F.lit(1).cast("long").alias("w"), (F.col("id") % 3 == 0).alias("marked"), F.lit(0).cast("long").alias("component"))
    for block in (100, 1 << 19):
        found = jaccard_join.link_counts(classes, jaccard_join.named_sets(df, classes), block).join(classes.select("digest", "id"), "digest").collect()
        links = collections.Counter()
        for r in found:
            links[r.id] += r.links
        want = brute_links(data)
        assert {k: links[k] for k in want} == want
        assert sum(r.other is not None for r in found) == sum(want[k] for k in want if k % 3 == 0)


def test_jaccard_leaders_join_a_group(spark, monkeypatch):
    """Near copies of one text link through it; the pairs to verify grow with the group, not with its square."""
    words = [f"w{k}" for k in range(100)]
    edited = lambda k: [f"e{k}-{j}" if j % 100 in (k % 97, (k * 7 + 31) % 97) else w for j, w in enumerate(words)]
    data = [(0, " ".join(words))] + [(k, " ".join(edited(k))) for k in range(1, 200)]
    seen, verified = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, sets: seen.append(pairs.distinct().count()) or verified(pairs, sets))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(data, "doc_id long, text string"), with_links=False).collect()}
    assert got == brute_components(dict(data)) and {c for _, c in got.values()} == {0}
    assert sum(seen) <= 2 * jaccard_join.MEET * jaccard_join.TURNS * len(data) and seen[-1] < len(data)


def test_mixing(spark):
    docs = [(i, "w " * 50, "big" if i < 600 else f"s{i % 4}") for i in range(1000)] + [(5000, None, "s0"), (5001, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df, entropy=0.99, blocks=16).toPandas()
    assert len(out) == len(docs)
    taken = collections.Counter()
    for r in out.itertuples():
        taken[r.source] += len((r.text or "").split()) * r.copies
    p = np.array([30000, 5000, 5000, 5000, 5000]) / 50000
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        w = p**mid / (p**mid).sum()
        lo, hi = (mid, hi) if -(w * np.log(w)).sum() >= 0.99 * math.log(5) else (lo, mid)
    w = p**lo / (p**lo).sum()
    for name, want in zip(("big", "s0", "s1", "s2", "s3"), w * 50000, strict=True):
        assert want - 100 <= taken[name] <= want + 1e-6
    assert mixing.mix(df.where("false")).count() == 0
    few = mixing.mix(df, entropy=0.99, blocks=16, few=0).toPandas()  # sources met in salted groups
    assert sorted(zip(few.doc_id, few.copies)) == sorted(zip(out.doc_id, out.copies))


def brute_mix(rows_, entropy, most):
    """Least and most tokens of each source that its budget allows."""
    n = collections.Counter()
    for _, t, s in rows_:
        n[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    n = {s: v for s, v in n.items() if v}
    p = np.array(list(n.values())) / sum(n.values())
    at = lambda e: p**e / (p**e).sum()
    reach = lambda e: -(at(e) * np.log(at(e))).sum() >= entropy * math.log(len(p))
    often = lambda e: (at(e) / p).max() > most
    found = []
    for test, ends in ((reach, (1.0, 1.0)), (often, (0.0, 0.0))):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if test(mid) else (lo, mid)
        found.append(ends[0] if test(ends[0]) == (test is reach) else (lo if test is reach else hi))
    return dict(zip(n, at(max(found)) * sum(n.values()), strict=True))


@pytest.mark.parametrize("entropy, most", [(0.9, 100.0), (0.99, 1.5), (0.2, 100.0)])
def test_mixing_weights(spark, entropy, most):
    data = [(k, "w " * (1 + k % 7), f"s{int(math.sqrt(k))}") for k in range(1, 900)] + [(0, "w", "one")] * 3 + [(9, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("key", "block", "at", "copies", "n", "row")})
    out = mixing.mix(df, entropy, most)
    assert out.columns == ["doc_id", "text", "source", "key", "block", "at", "n", "row", "copies"]
    taken, low = collections.Counter(), {}
    for r in out.collect():
        n = len((r.text or "").split())
        taken[r.source] += n * r.copies
        low[r.source] = max(low.get(r.source, 0), n * (3 if r.source == "one" else 1))
    for s, want in brute_mix(data, entropy, most).items():
        assert want - low[s] <= taken[s] <= want + 1e-6
    nulls = spark.createDataFrame([(None, None, None), (1, "", "a")], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.mix(nulls).collect()] == [1, 1]


def test_mixing_query_tempers(spark):
    docs = {r["doc_id"]: r for r in rows("documents")}
    data = [(i, r["text"], r["source"]) for i, r in docs.items()]
    taken, longest, copies = collections.Counter(), {}, collections.Counter()
    for r in QUERIES["op2_mixing"](spark, SMALL).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id]["text"] or ""))
        taken[r.source] += n * r.copies
        longest[r.source] = max(longest.get(r.source, 0), n)
        copies[r.copies] += 1
    assert sum(copies.values()) == len(data) and copies[2] and copies[0]  # some twice, some not at all
    same = collections.Counter((t or "") for _, t, _ in data)
    for s, want in brute_mix(data, 0.9999, 1.1).items():
        assert want - longest[s] * max(same.values()) <= taken[s] <= want + 1e-6


def test_licenses_in_hot_and_odd_rows(spark, monkeypatch):
    text = "a\nReleased under the MIT License.\nLicensed under CC BY 4.0.\nReleased under the MIT License."
    data = [(1, text, "x", "y", "z")] * 40 + [(1, None, None, "y", "z"), (None, "", "x", None, "z"), (2, "w " * 50000 + "\n// released under the mit license", "x", "y", "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, _digest string, of string, license string")
    for few in (20_000, 0):  # all joins by a shuffle in the second
        monkeypatch.setattr(licenses, "FEW", few)
        got = collections.Counter((r.doc_id, r._digest, r.of, r.license, tuple(r.line_licenses)) for r in licenses.scan(df).collect())
        assert got == {(1, "x", "y", None, ("CC-BY-4.0", "MIT")): 40, (1, None, "y", None, ()): 1, (None, "x", None, None, ()): 1, (2, "x", "y", None, ("MIT",)): 1}
    assert licenses.scan(df.where("false")).count() == 0


def test_licenses(spark):
    df = spark.createDataFrame([(1, "Copyright 2020 X\nReleased under the  MIT LICENCE"), (2, "a\nLicensed under CC BY-NC 4.0.\nb"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", ["MIT"]), 2: (None, ["CC-BY-NC-4.0"]), 3: (None, []), 4: (None, [])}


def test_licenses_as_published(spark):
    files = {f.stem: f.read_text() for f in Path(licenses.__file__).with_name("license_texts").glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= set(files)
    files |= {name: text for name, text in licenses.KNOWN[-2:]}
    want, data = [], []
    for name, text in files.items():
        body = textwrap.fill(text, 60) if name in ("MIT", "ISC") else text
        for head in ("", "Copyright (c) 2020 A B\n\n", "Copyright The X Authors\n") + (("MIT License\n\nCopyright (c) 2020 A B\n\n", "The MIT License (MIT)\n\n© A\n") if name == "MIT" else ()):
            whole = head + body
            data += [whole, "\n".join("# " + x for x in whole.split("\n")), "/*\n" + "\n".join(" * " + x for x in whole.split("\n")) + "\n */"]
            want += [name] * 3
    mit = files["MIT"]
    data += [textwrap.fill(mit, w) for w in range(40, 90, 7)] + [mit + " No more.", "MIT License\n", "MIT License"]
    want += ["MIT"] * 8 + [None] * 3
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(data))] == want
    own = spark.createDataFrame([("X", "My own\nterms."), ("Y", None)], "license string, text string")
    ask = spark.createDataFrame([(1, "# MY OWN terms"), (2, mit), (3, "a\nmy own terms")], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.line_licenses) for r in licenses.scan(ask, own).collect()} == {1: ("X", ["X"]), 2: (None, []), 3: (None, ["X"])}
    assert licenses.scan(ask, own.where("false")).where("license is not null or size(line_licenses) > 0").count() == 0


def test_html():
    page = "<head><title>T</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one <b>two\n three<br>four<p>five</p></article><footer>f</footer>"
    assert html_text.main_text(page) == "A & B\none two three four\nfive"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""


@pytest.mark.parametrize("item", ["<li>menu {}", "<dt>t {}<dd>d", "<li><b>menu {}"])
def test_html_unclosed_items(item):
    story = "<article><p>It is the story of the day and it was told in the town.</article>"
    page = "<body><nav><ul>" + "".join(item.format(k) for k in range(500)) + "</ul></nav>" + story
    assert html_text.main_text(page) == "It is the story of the day and it was told in the town."


STORY = "It is the story of the day and it was told in the town by the people who have seen it."


@pytest.mark.parametrize("page", [
    f"<div><h2>Head</h2><p>{STORY}<p>short line<p>{STORY}</div><p>lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt",
    f"<article class=teaser><h3><a href=x>Other</a></h3><p><a href=y>read this</a></article><div><h2>Head</h2><p>{STORY}<p>short line<p>{STORY}</div><article><a href=z>more</a></article>",
    f"<div><h2>Head</h2><p>{STORY}<p>short line<p>{STORY}</div><article class=comment><p>{STORY}</article>",
    f"<article><h2>Head</h2><p>{STORY}<p>short line<p>{STORY}</article><p><a href=x>{STORY}</a><p>{'far ' * 30}",
    f"<article><h2>Head</h2><p>{STORY.replace('day', '<a href=x>day</a>')}<p>short line<p>{STORY}</article>",
])
def test_html_block_rules(page):
    assert html_text.main_text(f"<body>{page}</body>") == f"Head\n{STORY}\nshort line\n{STORY}"


def test_html_article_breaks_ties():
    names = "Anna Berg, Carl Dorn, Emil Falk, Gerd Horn, Ida Jung, Karl Lang, Max Nord, Olaf Post"
    for tag, kept in (("article", True), ("div", False)):
        assert (names in html_text.main_text(f"<{tag}><p>{STORY}<p>{names}</{tag}>")) == kept
    assert html_text.main_text(f"<article><p>{names}</article>") == names
    assert html_text.main_text(f"<nav>x</nav><div><a href=a>a</a></div><article><p>{names}</article><div><a href=b>b</a></div>") == names


@pytest.mark.parametrize("inner", [
    "See <a href=x>the full report of the day and all of its tables</a>.", f"<a href=/x/>{STORY}</a> and more", "A &amp; B <a href=x>&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;</a> of the day", f"<a href=/x/>here</a> {STORY}",
])
def test_html_loses_nothing_of_an_article(inner):
    text = re.sub("<[^>]*>", "", inner).replace("&amp;", "&")
    assert html_text.main_text(f"<article><p>{STORY}<p>{inner}</p><p>{STORY}</article>") == f"{STORY}\n{text}\n{STORY}"


def test_html_counts_links_as_read():
    mixed = "It is the story &amp; <a href=x>&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;</a> of the day, and of the town it is in"
    assert html_text.blocks(f"<p>{mixed}") == [(re.sub("<[^>]*>", "", mixed).replace("&amp;", "&"), 8, False, 0)]
    assert html_text.blocks("<p><a href=/x/>in</a> out") == [("in out", 2, False, 0)] and html_text.blocks("<p><a href='x'/>out") == [("out", 0, False, 0)]


@pytest.mark.parametrize("name, kept", [("no-sidebar", True), ("share-this", True), ("comments-off", True), ("notice-board", True), ("has-sidebar wide", True), ("article-header", False), ("site_footer", False), ("sidebar-left", False), ("x ad-1", False), ("cookie-banner", False), ("comment-list", False), ("Sponsored", False), ("adventure", True)])
def test_html_names_of_surroundings(name, kept):
    assert html_text.main_text(f"<body><div class='{name}'><p>{STORY}</p></div>") == (STORY if kept else "")


@pytest.mark.parametrize("story", ["これは町の人々が見た一日の物語であり、町で語られた。", "Это рассказ о дне. Его рассказали в городе люди, которые всё видели.", "O vento soprava forte sobre os campos verdes. Ninguém sabia donde vinham aquelas nuvens escuras. Chegou depois uma chuva fria, miúda, que durou três dias inteiros. Quando parou, todos saíram à rua."])
def test_html_reads_other_languages(story):
    page = f"<body><div><a href=a>a b</a> <a href=b>c d</a></div><div><h2>X</h2><p>{story}</p><p>{story}</p></div><div><a href=c>e f</a></div>"
    assert html_text.main_text(page) == f"X\n{story}\n{story}"


def test_html_pages_without_article():
    """Hand-labelled: which blocks of pages whose parts have no names are the article."""
    menu = " ".join(f"<a href=/{k}>{w}</a>" for k, w in enumerate(("Home", "World", "Sport", "Weather and travel", "Contact us")))
    fill = "amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim"
    parts = [(f"<p>{menu}", None), ("<h1>A day in town</h1>", "A day in town"), ("<p>By Anna Berg, Monday", "By Anna Berg, Monday"), (f"<p>{STORY}", STORY), ("<p>Carl Dorn, Emil Falk, Gerd Horn and the mayor of the town, Ida Jung, were there", "Carl Dorn, Emil Falk, Gerd Horn and the mayor of the town, Ida Jung, were there"), (f"<p>{STORY} {STORY}", f"{STORY} {STORY}"), (f"<p>{menu}", None), ("<p>See also", None), (f"<p>{menu}", None), (f"<p>{fill}", None)]
    # the byline lies under a heading, between links and the story: nearest decided neighbours disagree, and it goes
    want = [text for _, text in parts if text and not text.startswith("By ")]
    assert html_text.main_text("<body><div>" + "".join(html for html, _ in parts) + "</div></body>") == "\n".join(want)


def test_html_long_and_empty(spark):
    df = spark.createDataFrame([(1, f"<p>{STORY}</p>" * 20000), (1, None), (2, ""), (2, "")], "page_id long, html string")
    got = df.select("page_id", html_text.extract(F.col("html")).alias("text"))
    assert sorted((r.page_id, len(r.text)) for r in got.collect()) == [(1, 0), (1, 20000 * (len(STORY) + 1) - 1), (2, 0), (2, 0)]
    assert got.where("false").count() == 0


def test_html_unclosed_depth():
    rows_ = "".join(f"<tr><td>a {k}<td>b" for k in range(100))
    page = f"<head><title>T</title><body><article><table>{rows_}</table>{'<span>' * 200}<p>in</article><p>out"
    found = html_text.blocks(page)
    assert len(found) == 202 and [b[0] for b in found if not b[3]] == ["out"]
    nested = "<ul><li>a<ul><li>b<li>c</ul><li class=ad>d<ul><li>e</ul><li>f</ul>g"
    assert [b[0] for b in html_text.blocks(nested)] == ["a", "b", "c", "f", "g"]
    assert [b[0] for b in html_text.blocks("<table><tr><td class=ad>x<table><tr><td>y</table>z<td>kept<tr><td>too</table>")] == ["kept", "too"]


def test_packing(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(byte_bpe())
    texts = {r["doc_id"]: r["text"] for r in rows("documents")} | {-1: None, -2: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = packing.pack(df, byte_bpe()).toPandas()
    for doc_id, part in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*model.encode(texts[doc_id] or "").ids, 1], "<u4")
        at = 0
        for r in part.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= 2048 and (part.offset.values == np.concatenate([[0], np.cumsum(part.length)[:-1]])).all()
    assert set(out.doc_id) == set(texts)


def test_differencing():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 512, 700)]
    found = packing.windows(sizes)
    assert sorted(i for w in found for i in w) == list(range(700))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) <= 2048 and len(found) <= -(-sum(sizes) // 2048) + 2


def test_exact_topk(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 1, 8) * (1 + i % 5)]) for i in range(400)]
    data += [(400, [1.0] * 8), (401, [1.0] * 8), (402, None), (403, [float("nan")] * 8), (404, [None] + [1.0] * 7)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    m = np.floor(256 * np.array([d[1] for d in data[:402]], np.float32).astype(float))
    want = []
    for q in range(0, 402, 50):
        s = m @ m[q]
        best = [j for j in np.lexsort((np.arange(402), -s)) if j != q][:5]
        want += [(q, k + 1, int(j), int(s[j])) for k, j in enumerate(best)]
    for size in (exact_topk.QUERY_BYTES, 128):  # one block of queries, and many
        assert sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5, size, 50 * size).collect())) == want
    assert exact_topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_exact_topk_edges(spark):
    rng = np.random.default_rng(4)
    data = [(i // 2, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(60)]  # each id twice
    data += [(i, [float(x) for x in rng.integers(-3, 3, 3) * 10.0**7 / 256]) for i in range(100, 130)]  # products beyond 2**53
    data += [(200, []), (201, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("row", "v", "dim", "norm", "score")})
    want = []
    whole = [None if i is None else [math.floor(256 * x) for x in v] for i, v in data]
    for a, q in enumerate(whole):
        if data[a][0] is not None and q and data[a][0] % 10 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), data[b][0]) for b, v in enumerate(whole) if b != a and v and len(v) == len(q))[:5]
            want += [(data[a][0], k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 10 == 0, 5, 200, 700).collect())) == sorted(want)
    with pytest.raises(Exception, match="long"):
        exact_topk.top_k(spark.createDataFrame([(0, [1e14]), (1, [1e14])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_warc(spark, tmp_path):
    body = "\x1f\x8b\x08 WARC/1.1\r\n\r\n"
    data = [(i, f"http://x/{i}", f"<p>{i % 7}</p>{body}") for i in range(60)] + [(100, None, None), (101, "", ""), (101, "", ""), (None, "u", "only")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    groups = collections.defaultdict(list)
    for i, _, h in data:
        groups[(h or "").encode()].append(i)
    want = []
    for b, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top) for i in ids]
    files = warc.written(warc.write(df, f"file://{tmp_path}/w"), "test-files")
    for split in (37, 1 << 20):
        got = warc.read(spark, files, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_warc_records(spark, tmp_path):
    urls = ["http://x/a b?q=é&r=%20", "", "http://x/\r\nX-Page: 9", None]
    df = spark.createDataFrame([(k, u, f"p{k}" * 700_000) for k, u in enumerate(urls)], "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("sha", "n", "refers_to", "revisit")})
    files = warc.written(warc.write(df, f"file://{tmp_path}/w"), "test-files")
    assert {r.page_id: (r.url, r.payload_bytes) for r in warc.read(spark, files).collect()} == {k: (u, 1_400_000) for k, u in enumerate(urls)}
    assert warc.round_trip(df.where("false")).count() == 0
    foreign = b"".join(zlib.compress(x, wbits=31) for x in (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"not a record", b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Record-ID: <urn:x>\r\n\r\nbody"))
    (tmp_path / "f.warc.gz").write_bytes(foreign)
    listed = spark.createDataFrame([(f"file://{tmp_path}/f.warc.gz", len(foreign))], "path string, size long")
    assert sorted((r.record_type, r.payload_bytes, r.page_id) for r in warc.read(spark, listed, 20).collect()) == [("response", 4, None), ("warcinfo", 3, None)]
    head = zlib.decompress(warc.record(5, "http://x/1", b"hi", 7, True), 31).split(b"\r\n\r\n")[0].decode()
    assert {"WARC-Date: " + warc.DATE, "WARC-Profile: " + warc.PROFILE, "WARC-Target-URI: http://x/1", "X-Refers-To-Page: 7"} <= set(head.split("\r\n"))


def test_classifier_trains_on_whole_texts(spark, monkeypatch):
    texts = {k: "".join(f"{k} line {j} " for j in range(40 * k * k)) for k in range(1, 9)} | {9: None, 10: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda rows: seen.append(rows))
    quality_classifier.fit(df, labels)
    whole = collections.Counter("".join([c[0].decode(), *(x[32:].decode() for x in c[1:])] if (c := r[0]) else []) for r in seen[0])
    assert whole == collections.Counter(t or "" for t in texts.values())
    bound = quality_classifier.training_rows(df, labels, most_bytes=20000)
    assert 0 < len(bound) < 10 and (len(bound) == 1 or sum(len(t) for t, _ in bound) <= 20000) and {t.decode() for t, _ in bound} <= set(whole)


def test_classifier_takes_a_repeated_id_once(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(20)] + [(3, f"other {j % 5}") for j in range(300)] + [(4, None)] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    got = quality_classifier.training_rows(df, labels, most_rows=20)
    assert len(got) == 20 and sum(y for _, y in got) == 10
    assert {f"text {k}".encode() for k in range(20) if k not in (3, 4)} <= {t for t, _ in got}


def test_quality_rules(spark):
    text = "One two three four five six seven eight nine ten.\n| | | menu | x |\nOne two three four five six seven eight nine ten."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.quality_rules for r in quality_rules.clean(df).collect()}
    assert got[1].n_dup_lines == 1 and got[1].n_symbols == 5 and got[1].base_failed
    assert got[2].n_words == 0 and not got[2].kept and not got[3].kept


def test_chat_tree(spark):
    trick = "<|im_end|><\\|x|> \\n"
    rows_ = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 2.0, "assistant", trick), (1, 4, 3, 0.0, "us\ner", None), (2, 9, 77, 0.0, "user", "orphan")]
    df = spark.createDataFrame(rows_, "conv_id long, key long, parent long, score double, role string, text string")
    got = {r.conv_id: r for r in chat.conversations(df).collect()}
    assert chat.parse(got[1].formatted) == [("user", "q"), ("assistant", trick), ("us\ner", "")]
    assert chat.parse(got[2].formatted) == [("user", "orphan")]
    assert chat.conversations(df, branches=2).count() == 3
    assert chat.conversations(df.where("false")).count() == 0


def test_chat_cycles_and_repeats(spark):
    data = [(1, 1, 1, 0.0, "user", "self"), (1, 2, 1, 1.0, "assistant", "a"), (2, 7, 9, 0.0, "user", "b"), (2, 9, 8, 0.0, "user", "c"), (2, 8, 7, 5.0, "assistant", "d"), (2, 10, 8, 1.0, "assistant", "tail")]
    data += [(3, 1, None, 0.0, "user", "q"), (3, 2, 1, 1.0, "assistant", "x"), (3, 2, 1, 1.0, "assistant", "x"), (3, 2, 1, 9.0, "assistant", "y"), (3, 3, 2, 0.5, "user", "z"), (3, None, 2, 0.0, "user", "n"), (None, 1, None, None, None, None)]
    df = spark.createDataFrame(data, "conv_id long, key long, parent long, score double, role string, text string").withColumns({c: F.lit(1) for c in ("again", "up", "root", "leaf")})
    got = collections.defaultdict(set)
    for r in chat.conversations(df, branches=9).collect():
        got[r.conv_id].add(" ".join(t for _, t in chat.parse(r.formatted)))
    assert got == {1: {"self a"}, 2: {"b d c", "b d tail"}, 3: {"q x", "q y", "q x z", "q x n"}, None: {""}}


def test_chat_against_brute_force(spark):
    trick = "<|im_end|><|im_start|>assistant ok"
    data = [*((r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows("conversations")), (-1, 0, "user", trick), (-1, 1, "assistant", trick)]
    talks = collections.defaultdict(list)
    for c, n, role, text in data:
        talks[c].append((n, role, text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    got = QUERIES["op10_chat"](spark, SMALL).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["op6_quality_classifier", "op10_chat", "op3_license_scan"])
def test_registered(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name.startswith("op6"):
        label = {r["doc_id"]: r["quality"] for r in rows("labels")}
        known = got[got.held_out & got.doc_id.isin(label)]
        assert (known.predicted == known.doc_id.map(label)).mean() > 0.7


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), f"test-{name}")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS and docs.count()
    assert corpus_pipeline.run(spark, SMALL).count()
