"""Spelling variants, collocations and URL filters against plain versions."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastervec.llm import phrases, queries, spelling, url_filters

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_collocations", "op13_url_filter"])
def test_same_rows_as_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "pages"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), base.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    want = sorted(map(str, want.project(", ".join(order)).fetchall()))
    assert want and sorted(str(tuple(r)) for r in got.select(order).collect()) == want


# ---- spelling ----


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], form[w], root, len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", ["ab", "aé\u00ffbc", "abcdefghij"])
def test_near_words_and_roots_equal_all_pairs(spark, letters):
    rng = random.Random(letters)
    words = {"".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(150)}
    words |= {w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in list(words) for i in [rng.randrange(len(w))]} | {"a" * k for k in range(5, 12)}
    n = {w: rng.choice([3, 3, 7, 20, 90, 500]) for w in words if len(w) >= 5}
    got = spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(n)


def test_long_chains_of_forms_reach_their_root(spark):
    n = {"a" * 5 + "b" * k: 3 << k for k in range(12)}
    got = spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r["root"] for r in got} == {"a" * 5 + "b" * 11} and sorted((tuple(r) for r in got), key=str) == plain_groups(n)


def test_word_counts_of_odd_texts(spark):
    long = "Straße ÉTUDES " * 200_000
    rows = [(1, None), (1, ""), (None, "HOUSES houses x1houses"), (None, "HOUSES houses x1houses"), (3, "1234 abcd"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == {"houses": 6, "straße": 200_000, "Études": 200_000}
    spoilt = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 5 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            spoilt[run] += len(run) >= 5
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs, misspell_every=5).collect()} == {w: n for w, n in spoilt.items() if n >= 3}
    none = spelling.variant_groups(spelling.word_counts(docs.where("false")))
    assert none.columns == ["word", "n", "form", "root", "n_near", "form_n"] and none.count() == 0


# ---- collocations ----


def plain_phrases(rows, most):
    out = collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    out[lang or "und", " ".join(words[i : i + m])] += 1
    return out


def test_bitmaps_count_phrases_of_any_length():
    rng = random.Random(3)
    rows = [("".join(rng.choices("ab AB.,\t\n é", k=rng.randint(0, 90))), rng.choice(["x", "y"])) for _ in range(300)] + [("", "x"), (". .", "y"), ("a " * 2000, "x")]
    shard = phrases.Shard(pa.array([t for t, _ in rows], pa.large_string()), pa.array([lang for _, lang in rows]))
    got = collections.Counter()
    parts = [(np.arange(len(shard.words))[:, None], shard.n), *shard.grow(4, lambda a, b: np.ones(len(a), bool))]
    for batch in (shard.rows(*part) for part in parts):
        for lang, phrase, n in zip(*(c.to_pylist() for c in batch.columns)):
            got[lang, phrase] += n
    assert got == plain_phrases(rows, 4)


def test_the_filter_loses_no_frequent_phrase_even_when_full(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choices("abcdefg", k=40)), rng.choice(["x", None])) for _ in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1))
    want = {k: n for k, n in plain_phrases(rows, 4).items() if n >= 10}
    for bits in (phrases.FILTER_BITS, 1 << 15):
        got = {(r["lang"], r["phrase"]): r["n"] for r in phrases.phrase_counts(docs, most_words=4, filter_bits=bits).where("phrase <> ''").collect()}
        assert got == want


def test_collocations_of_odd_tables(spark):
    rows = [(None, None), ("", "x"), ("new york " * 30, "x"), ("new york " * 30, "x"), ("A b. " * 10, None), ("z" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit(1))
    got = [(r["lang"], r["rank"], r["phrase"], r["a"], r["n"]) for r in phrases.collocations(docs).collect()]
    assert set(got) == {("und", 1, "a b", 10, 20), ("x", 1, "new york new", 58, 121), ("x", 2, "york new york", 58, 121)}
    assert phrases.collocations(docs.where("false")).count() == 0


def test_scores_pass_64_bits(spark, monkeypatch):
    a = 1 << 40
    found = spark.createDataFrame([("x", "", a), ("x", "p", a), ("x", "q", a + 1), ("x", "p q", a - 1)], "lang string, phrase string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_, **__: found)
    got = phrases.collocations(spark.createDataFrame([("x", "x")], "text string, lang string")).collect()
    assert [r["score"] for r in got] == [1_000_000 * (a - 1) ** 2 // (a * (a + 1))]


# ---- URLs ----

RULES = queries.RULES


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.match("(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(rule), rule, verdict) for verdict, rule in RULES if ("." + host).endswith("." + rule.partition("/")[0]) and path.startswith("/" + rule.partition("/")[2])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "no url", "http://", "http://WWW.Example.COM/en/x?y#z", "http://a.www.example.com/en/", "http://example.com/en/a", "http://notexample.com/en/", "http://example.com", "https://example.com?x=/en/", "http://x.net/es/", "http://x.net/es", "ftp://x.net/fr/é\n/b", "http://x.net:80/fr/", "a://b://c.com/", "http://É.com/É", "http://com/"]


def test_rules_equal_a_plain_reading(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "html": F.lit(None).cast("string")})
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, RULES, url_filters.junk(F.col("html"))).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS + URLS):
        host, path, rule, verdict = plain_url(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_filters.filter_urls(pages.where("false"), [], F.lit(None).cast("int")).count() == 0


def test_reputation_shrinks_hosts_to_their_domains(spark):
    rng = random.Random(7)
    pages = [(f"http://h{h}.{d}.{s}/{i}", int(rng.random() < rate)) for s, d, rate in (("org", "good", 0.02), ("org", "bad", 0.7), ("net", "fine", 0.05)) for h in range(8) for i in range(40)]
    pages += [("http://new.bad.org/", 0), ("http://new.good.org/", 1), ("http://none.bad.org/", None), ("http://none.fine.net/", None)] + [("http://big.fine.net/x", 0)] * 3000
    rows = spark.createDataFrame(pages, "url string, bad int")
    got = {r["host"]: r for r in url_filters.reputation(rows, F.col("bad")).collect()}
    assert got["new.bad.org"]["mean"] > 0.4 and got["none.bad.org"]["mean"] > got["new.bad.org"]["mean"] and got["new.good.org"]["mean"] < 0.3
    assert got["none.bad.org"]["n"] == 0 and got["big.fine.net"]["n"] == 3000 and all(0 <= r["mean"] <= 1 and r["low"] < r["mean"] < r["high"] for r in got.values())
    verdicts = url_filters.filter_urls(rows.withColumn("page_id", F.monotonically_increasing_id()), [("allow", "h3.bad.org/")], F.col("bad")).select("host", "verdict").distinct().collect()
    assert {r["host"] for r in verdicts if r["verdict"] == "block"} == {f"h{h}.bad.org" for h in range(8) if h != 3} | {"new.bad.org", "none.bad.org"} - {h for h in ("new.bad.org", "none.bad.org") if got[h]["low"] <= 0.2}


def plain_posteriors(hosts):
    """host -> posterior mean from host -> (domain, suffix, n, k), by the definition."""
    total = lambda rows: (sum(r[0] for r in rows), sum(r[1] for r in rows))

    def shrink(children):
        spread = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in children.values() if n)
        room = sum(n * (n - 1) * m * (1 - m) for n, k, m in children.values())
        rho = min(max(spread / room if room else 0, 1 / 1001), 1 / 2)
        s = 1 / rho - 1
        return {key: (k + s * m) / (n + s) for key, (n, k, m) in children.items()}

    n, k = total([h[2:] for h in hosts.values()])
    root = (k + 0.05) / (n + 1)
    suffix = shrink({s: (*total([h[2:] for h in hosts.values() if h[1] == s]), root) for s in {h[1] for h in hosts.values()}})
    domain = shrink({d: (*total([h[2:] for h in hosts.values() if h[0] == d]), suffix[d.split(".")[-1]]) for d in {h[0] for h in hosts.values()}})
    return shrink({h: (n, k, domain[d]) for h, (d, s, n, k) in hosts.items()})


def test_posteriors_equal_the_definition(spark):
    rng = random.Random(8)
    rows = [(f"http://h{rng.randint(0, 6)}.d{rng.randint(0, 3)}.{rng.choice(['a', 'b'])}/", rng.choice([0, 0, 1, None])) for _ in range(900)]
    got = {r["host"]: r for r in url_filters.reputation(spark.createDataFrame(rows, "url string, y int"), F.col("y")).collect()}
    want = plain_posteriors({h: (r["domain"], r["suffix"], r["n"], r["k"]) for h, r in got.items()})
    assert all(abs(got[h]["mean"] - m) < 1e-8 for h, m in want.items())
