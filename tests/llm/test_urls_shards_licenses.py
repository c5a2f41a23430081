"""URL filters, sharding and license scans on small cases and against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from perilscope.llm import licenses, shards, urls

RULES = [("net/", "block", False), ("example.net/en/", "allow", False), ("example.com/de/", "block", False),
         ("org/fr/", "allow", False), ("bad.example.org", "block", True), ("good.bad.example.org", "allow", True),
         ("net/", "block", True), (None, "block", False), ("x.net/", None, False)]


def rule_of(host, path, listed):
    best = None
    for key, verdict, kind in RULES:
        if key is None or verdict is None or kind != listed:
            continue
        rule_host, slash, rest = key.partition("/")
        fits = host == rule_host or host.endswith("." + rule_host)
        if fits and path.startswith(slash + rest) and (best is None or len(key) > len(best[0])):
            best = (key, verdict)
    return best


URLS = [None, "", "no scheme", "http://", "http://NET/", "https://a.B.net/x?y#z", "http://net", "http://net?/en/",
        "http://example.net/en/1", "http://www.example.net/en", "http://xexample.net/en/", "http://example.com/de/",
        "http://example.com/DE/", "ftp://q.org/fr/a#b?c", "http://org/fr/", "http://bad.example.org/", "http://a.bad.example.org?x",
        "http://good.bad.example.org/fr/", "http://good.bad.example.org", "a://b://c.net/", "http://é.net/é", "http://net#//",
        "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://a.B.net/x?y#z"]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(RULES, "key string, verdict string, listed boolean")


@pytest.mark.parametrize("max_bytes", [urls.MAX_BYTES, 0])
def test_urls_get_the_longest_entry(spark, entries, max_bytes):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = urls.filter_urls(pages, entries, max_bytes=max_bytes)
    rows = {r["page_id"]: r for r in out.collect()}
    assert len(rows) == len(URLS)
    for k, url in enumerate(URLS):
        host, path = urls.split_url(url)
        rule, listed = rule_of(host, path, False), rule_of(host, path, True)
        r = rows[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), url
        assert r["verdict"] == (rule or listed or (None, "allow"))[1], url


def test_url_parts():
    assert urls.split_url("HTTP://User@Ex.COM:80/A/b?c#d") == ("user@ex.com:80", "/A/b")
    assert urls.split_url("x://É.Com#/a") == ("É.com", "")


def test_collisions_never_decide(tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(urls, "digest", lambda keys: np.array([len(k) for k in keys], np.uint64))
    path = str(tmp_path / "index.bin")
    urls.Index.write(path, ["abc", "xyz", "long"], [0, 1, 2])
    assert urls.Index(path).probe(["xyz", "abc", "foo", "long", ""]) == [[1], [0], [], [2], []]
    urls.Index.write(path, [], [])
    assert urls.Index(path).probe(["a"]) == [[]]


def test_no_urls_and_no_entries(spark, entries):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.filter_urls(pages, entries.limit(0)).first()["verdict"] == "allow"
    assert urls.filter_urls(pages.limit(0), entries).count() == 0


# --- sharding -----------------------------------------------------------------

def test_shards_are_even_gapless_and_whole(spark, tmp_path):
    rows = [(i, "t" * (i % 50), i) for i in range(997)] + [(5, "same", 1)] * 300 + [(None, None, None), (4, "", 0), (4, "é" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    shuffled = shards.external_shuffle(docs, bucket_bytes=4096)
    assert shuffled.n_buckets > 5
    out = shuffled.shards(24)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
    assert sorted(r["shard"] for r in per) == list(range(24))
    assert {r["n"] for r in per} <= {len(rows) // 24, len(rows) // 24 + 1}
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 and r["d"] == r["n"] for r in per)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, out.collect())) == sorted((str(a), str(b)) for a, b, _ in rows)
    # no bucket takes the repeated rows
    biggest = shuffled.read().where("text = 'same'").groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert biggest < 150
    order = [r["doc_id"] for r in out.orderBy("shard", "slot").collect() if r["doc_id"] is not None]
    assert order != sorted(order)
    shuffled.write_shards(24, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_fewer_rows_than_shards_and_none(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x") for i in range(5)], "doc_id long, text string")
    out = shards.external_shuffle(docs).shards(24).collect()
    assert len(out) == 5 and len({r["shard"] for r in out}) == 5 and {r["slot"] for r in out} == {0}
    assert shards.external_shuffle(docs.limit(0)).shards(24).count() == 0


def test_sharding_and_license_plans_have_no_python(spark, sf_dir):
    from perilscope.llm import queries

    for name in ("op4_sharding", "op10_license_scans"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# --- licenses -----------------------------------------------------------------

TEMPLATES = [("a", "red green blue black white"), ("b", "red stone"), ("c", "one two three four five six seven eight nine ten")]
PHRASES = [("mit license", "mit"), ("license mit", "back"), ("x x x", "xs")]


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]
    words = split(lower)
    places = sorted(
        (i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )
    blocks = []
    for label, template in TEMPLATES:
        whole = set(template.split())
        size, need = math.ceil(len(template.split()) / 0.8), len(whole) if len(whole) < 10 else math.ceil(0.8 * len(whole))
        for i in range(len(words)):
            held = len(whole.intersection(words[i : i + size]))
            if words[i] in whole and held >= need:
                blocks.append((i, min(size, len(words) - i), label, round(held / len(whole), 9)))
    return len(words), places, sorted(blocks)


def license_texts():
    r = random.Random(2)
    pool = "red green blue black white stone one two three four five six seven eight nine ten mit license x MIT License É k".split()
    texts = [None, "", "\n\n", "mit license mit license", "x x x x x", "MIT\nLicense", "red, STONE!\r\nred green blue black"]
    texts += ["".join(r.choice(pool) + r.choice([" ", " ", ", ", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    return texts + ["word " * 40_000 + "\nwhite black blue\ngreen word red\n" + "mit license " * 3, texts[9]]


def test_scans_equal_a_plain_search(spark):
    texts = license_texts()
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, blocks string")
    out = licenses.scan_licenses(docs, templates=TEMPLATES, phrases=PHRASES)
    rows = {r["doc_id"]: r for r in out.collect()}
    for k, text in enumerate(texts):
        r = rows[k]
        places = sorted((p["word"], p["label"]) for p in r["places"])
        blocks = sorted((b["word"], b["words"], b["label"], round(b["containment"], 9)) for b in r["blocks"])
        assert (r["n_words"], places, blocks) == brute(text), text


def test_scans_of_nothing(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    row = licenses.scan_licenses(docs, templates=[], phrases=[]).first()
    assert row["places"] == [] and row["blocks"] == [] and row["n_words"] == 2
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, templates=[("a", "?!")])


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file"""
BSD = """Redistribution and use in source and binary forms, with or without
   modification, are permitted provided that the following conditions are met"""


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (MPL, {"mpl"}),
        (BSD, {"bsd"}),
        ("words before " * 5000 + MPL.replace("\n", " ") + " words after" * 5000 + BSD, {"mpl", "bsd"}),
        (BSD.replace("source and", "source code and also"), {"bsd"}),
        ("the software was released under the license of a dog", set()),
        ("Licensed under the Mozilla Public License, Version 2.0", set()),
        ("Licensed under\r\nCC BY-NC 4.0.", {"cc-by-nc"}),
        ("\n".join("any use of this file may be except for the License in compliance with you not".split()), {"apache"}),
        (" and then of course ".join(MPL.split()), set()),
        ("Licensed under C\u212a BY-NC 4.0", set()),
    ],
)
def test_notices_over_line_ends(spark, text, labels):
    docs = spark.createDataFrame([(text,)], "text string")
    assert {b["label"] for b in licenses.scan_licenses(docs).first()["blocks"]} == labels
