"""The divergence audit and the URL filter against plain loops, and on odd and empty tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spotloom.llm import divergence, frames, urlfilter

FOLD = {i: i + 32 for i in range(65, 91)}


def plain_divergence(rows, least=3, heap=200):
    """Ranked pairs and terms from (text, lang, source), in whole numbers of Python."""
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(t.translate(FOLD) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        docs[lang or ""].update(found.keys())
        n[lang or "", source or ""].update(found)
    out = []
    for lang in {k[0] for k in n}:
        kept = sorted(t for t, c in docs[lang].items() if c >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        own = {s: share(c) for (x, s), c in n.items() if x == lang}
        every = share(sum((c for (x, _), c in n.items() if x == lang), Counter()))
        for s, p in own.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in own.items() if o != s]
            terms = [((p[t] - every[t]) ** 2 // every[t], t) for t in kept if n[lang, s][t] and p[t] > every[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, heap)):
                best = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(best, 1)]
    return sorted(out)


def diverged(docs, **how):
    return sorted(tuple(r) for r in divergence.diverge(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("terms, sources", [(2048, 128), (7, 2)])
def test_divergence_equals_plain_loops_for_tiles_of_any_size(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rng = np.random.default_rng(5)
    words = ["The", "the", "café", "ÉT", "zz", "x1y", "日本", "I'm", "É"] + [chr(97 + i) * 3 for i in range(20)]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), ["en", "de", None, ""][rng.integers(0, 4)], f"s{min(rng.integers(0, 12), 6)}") for _ in range(160)]
    rows += [("", "en", "only empty"), (None, "en", None), ("solo", "xx", "a"), ("other", "xx", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for heap in (200, 3):
        assert diverged(docs, heap=heap) == plain_divergence(rows, heap=heap)


def test_divergence_of_odd_rows_and_of_none(spark, odd_docs, no_docs):
    rows = [(r[1], r[2], r[3]) for r in odd_docs.collect()]
    assert diverged(odd_docs) == plain_divergence(rows) and diverged(no_docs) == []


def test_counts_are_passed_on_in_parts_and_long_texts_are_split_alike(monkeypatch):
    texts = ["aa bb aa", "cc " * 40 + "é" * 30, None, "AA-dd"]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["s", "s", "t", "s"]), pa.array([t or "" for t in texts])], ["lang", "source", "text"])
    whole = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(divergence, "HELD", 1)
    monkeypatch.setattr(divergence, "PIECE", 8)
    parts = [r for b in divergence._counted(iter([batch])) for r in b.to_pylist()]
    total = lambda rows, c: {k: sum(r[c] for r in rows if (r["source"], r["term"]) == k) for k in {(r["source"], r["term"]) for r in rows}}
    assert len(parts) > len(whole) and total(whole, "n") == total(parts, "n") and total(whole, "docs") == total(parts, "docs")
    assert total(whole, "n") == {("s", "aa"): 3, ("s", "bb"): 1, ("s", "cc"): 40, ("s", "é" * 30): 1, ("s", "dd"): 1} and total(whole, "docs")["s", "cc"] == 1


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 8 * 10**15), st.integers(0, 8 * 10**15))
def test_shares_are_exact_for_any_count(n, more):
    assert int(divergence.shares(np.array([n]), np.array([n + more + 1]))[0]) == 1 + 10**9 * (n + 1) // (n + more + 1)


def test_meeting_in_steps_is_meeting_at_once(monkeypatch):
    p = np.random.default_rng(0).integers(1, 10**9, (9, 11))
    want = [[sum((int(x) - int(y)) ** 2 // int(y) for x, y in zip(a, b)) for b in p[:4]] for a in p]
    monkeypatch.setattr(divergence, "CELLS", 50)
    assert divergence.meet(p, p[:4]).tolist() == want


def test_heaps_are_cut_before_the_shuffle(spark, sf_dir):
    plan = divergence.diverge(frames.table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("ORG", "/fr/", "allow"), ("a.b", "", "block"), ("b", "/x", "allow"), ("", "/", "block"), (None, "/", "block"), ("net", "/", "allow"), ("net", "/", "block")]


def plain_verdict(url, rules):
    after = (url or "").split("://", 1)
    host, path = re.match(r"([^/?#]*)([^?#]*)", after[1] if len(after) == 2 else "", re.S).groups()
    host = host.translate(FOLD)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((h and h.translate(FOLD), p, v) for h, p, v in rules) if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    None, "", "no url", "http://", "http://net", "http://net/", "HTTP://NET/", "http://www.net/a?x=1", "http://example.net/en/1", "http://m.Example.net/en", "http://example.net/en?/en/", "http://example.net#/en/",
    "http://notexample.net/en/1", "http://x.example.com/de/1", "http://example.com/en/", "ftp://a.org/fr/x", "a.org/fr/x", "http://org/fr/", "http://a.b", "http://c.a.b/x", "http://b/x", "http://b/xy", "http://a..net/", "http://.net/",
    "http://é.net/ü\n/", "http://x\nnet/", "http://a://b/x", "http://user@net:80/", "http://" + "a." * 3000 + "net/" + "p" * 100_000, "http://net/", "http://net/", "http://xn.b/X",
]


@pytest.mark.parametrize("listed", [urlfilter.LISTED, 1])
def test_verdicts_equal_plain_rules(spark, monkeypatch, listed):
    monkeypatch.setattr(urlfilter, "LISTED", listed)
    urls = spark.createDataFrame([(i, u, "clash", 1, "x") for i, u in enumerate(URLS)], "page_id long, url string, URL string, rule int, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(urls, rules).collect()}
    assert got == {i: plain_verdict(u, RULES) for i, u in enumerate(URLS)}
    assert {r.verdict for r in urlfilter.judge(urls, rules.where("false")).collect()} == {"allow"}
    assert urlfilter.judge(urls.where("false"), rules).collect() == []


@pytest.mark.parametrize("parts", [1, 3])
def test_a_cascade_is_exact_over_its_universe(spark, monkeypatch, tmp_path, parts):
    """Enough keys that filters mistake many, on several levels."""
    monkeypatch.setattr(urlfilter, "LISTED", -(-700 // parts))
    scratch = frames.Scratch(spark)
    universe = spark.range(6000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.crc32(F.col("key").cast("binary")) % 9 == 0)
    cascades = urlfilter.build(universe, listed, scratch, "test")
    assert len(cascades) >= parts and max(len(c) for c in cascades) >= 3
    said = F.lit(False)
    for p, levels in enumerate(cascades):
        said = F.when(urlfilter._part(F.col("key"), len(cascades)) == p, urlfilter.is_listed(spark, F.col("key"), levels)).otherwise(said)
    wrong = universe.withColumn("said", said).where(F.col("said") != (F.crc32(F.col("key").cast("binary")) % 9 == 0))
    assert wrong.count() == 0
    plan = universe.select(said)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    bits = sum(level.bits for levels in cascades for level in levels)
    assert bits < 12 * listed.count()
