"""The Jaccard join and the neighbour search against all pairs; the pipeline against plain stages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.llm import ann, components, jaccard

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed, groups=25, unrelated=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 11, 12, 40, 120]))]
        if r.random() < 0.5:
            base += passage
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(copy[: len(copy) - r.choice([0, 0, 1, 2])])
    rows += [passage + [r.choice(vocabulary) for _ in range(r.randint(0, 60))] for _ in range(unrelated)]
    base = [f"x{i}" for i in range(100)]  # one large group of near copies, chained by small steps
    for k in range(40):
        rows.append(base[k // 2 :] + [f"y{i}" for i in range(k // 2)])
    texts = [" ".join(x) for x in rows]
    out = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(out)
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "one two"), (None, texts[0]),
                  (1006, texts[0].upper()), (3, texts[3]), (1007, "long " * 20_000 + "tail")]


@pytest.mark.parametrize("seed,frequent", [(1, 16), (2, 2), (3, 6)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "STAR", 3)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n long, component_id string")
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect()]
    assert sorted(out, key=str) == brute(rows)


def test_links_between_groups_are_found_without_the_first_step(spark, monkeypatch):
    """The prefix join alone finds every link."""
    none = lambda shared: shared.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    monkeypatch.setattr(jaccard, "_key_pairs", none)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rows = near_copies(7, groups=15, unrelated=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect()]
    assert sorted(out, key=str) == brute(rows)


def test_one_of_each_component_stays(spark):
    rows = near_copies(5, groups=6, unrelated=5)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, lang string")
    kept = jaccard.one_of_each(docs)
    want = sorted({k for k, _, c in brute(rows) if k is not None and k == c} | {1000, 1001, 1002})
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(k for k in got if k is not None) == want and got.count(None) == 1


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(docs).count() == 0 and jaccard.one_of_each(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 200), (139, 300)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 140)}, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- neighbours -----------------------------------------------------------------

def vectors(spark, data):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 1) for k, v in data], "vec_id long, embedding array<float>, score int")


def exact(data, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in data]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            best = {}
            for i, y in good:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((x * y).sum()))
            out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_neighbours_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 40)
    monkeypatch.setattr(ann, "CHUNK", 64)
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 16)) * 3
    data = [(i, centres[i % 12] + r.standard_normal(16) * (1 + i % 3)) for i in range(1500)]
    data += [(i, centres[0]) for i in range(1500, 1900)]  # one vector many times
    bad = [(None, centres[0]), (5000, None), (5001, [0.0] * 16), (5002, [np.nan] + [1.0] * 15), (5003, [np.inf] * 16), (5004, [1.0] * 3), (5005, [None] * 16)]
    out = {}
    for x in ann.nearest(vectors(spark, data + bad), F.col("vec_id") % 20 == 0).collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = exact(data)
    assert set(out) == set(want)
    hit = 0
    for q, best in want.items():
        got = sorted(out[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        hit += sum(g[2] >= best[-1][1] - 1e-9 for g in got)
    assert hit >= 0.9 * 20 * len(want)
    assert {i for _, i, _ in out[1500]} == {i for i, _ in want[1500]}  # ties go to the smaller id


def test_few_vectors_are_all_returned(spark):
    data = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.5]), (2, [-3.0, 0.5]), (20, [0.1, 0.1])]
    out = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in ann.nearest(vectors(spark, data), F.col("vec_id") % 20 == 0).collect())
    want = sorted((q, n + 1, i, s) for q, best in exact(data).items() for n, (i, s) in enumerate(best))
    assert [o[:3] for o in out] == [w[:3] for w in want] and np.allclose([o[3] for o in out], [w[3] for w in want])
    assert ann.nearest(vectors(spark, data[:1]), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


# --- pipeline ---------------------------------------------------------------------

def test_pipeline_against_plain_stages(spark, sf_dir):
    import corpus_pipeline as P
    from tests.llm.test_decontaminate import words
    from tests.llm.test_near_rule import brute as near
    from tokenizers import Tokenizer
    from perilscope.llm.queries import TOKENIZER, read

    docs = read(spark, sf_dir, "documents")
    stage = dict(P.STAGES)
    known = stage["language"](spark, docs, sf_dir)
    assert known.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in known.collect()}
    assert len(kept) >= 0.97 * docs.count()
    one = [(k, t) for k, t in kept.items()]
    alone = {k for k, n, c in near(one, P.NEAR.width, P.NEAR.part, P.NEAR.whole) if k == c}
    windows = set()
    for r in read(spark, sf_dir, "benchmark").collect():
        w = words(r["text"])
        size = min(10, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1 if w else 0)}
    sizes = {len(w) for w in windows}
    clean = {
        k for k in alone
        if not any(tuple(words(kept[k])[i : i + s]) in windows for s in sizes for i in range(len(words(kept[k])) - s + 1))
    }
    library = Tokenizer.from_file(TOKENIZER)
    out = {r["doc_id"]: r["tokens"] for r in P.run(spark, sf_dir).collect()}
    assert set(out) == clean
    for k in list(clean)[:40]:
        assert out[k] == library.encode(kept[k], add_special_tokens=False).ids


def test_a_query_that_found_too_few_reads_all_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 10)
    monkeypatch.setattr(ann, "PROBES", 1)
    r = np.random.default_rng(4)
    data = [(i, r.standard_normal(8)) for i in range(200)]
    out = {}
    for x in ann.nearest(vectors(spark, data), F.col("vec_id") % 20 == 0).collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert set(out) == set(range(0, 200, 20)) and all([k for k, _ in sorted(v)] == list(range(1, 21)) for v in out.values())
