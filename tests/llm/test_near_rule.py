"""The Jaccard join and the pipeline's stage at 5-word shingles and 0.8, against all pairs."""

import re

import pytest

import corpus_pipeline as P
from perilscope.llm import jaccard
from tests.llm.test_pairs import LOWER, near_copies


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, part, whole):
    sets = [shingles(t, width) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and whole * both >= part * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("seed,frequent,first_step", [(1, 16, True), (2, 2, True), (7, 4, False)])
def test_components_at_five_words_and_eight_tenths(spark, monkeypatch, seed, frequent, first_step):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    if not first_step:
        monkeypatch.setattr(jaccard, "_key_pairs", lambda shared: shared.selectExpr("node as a", "node as b").limit(0))
    words = [f"s{i}" for i in range(9)]
    short = [(2000 + k, " ".join(words[:n])) for k, n in enumerate((8, 9, 7, 4, 5))]  # 4 of 5 shingles in common is a link
    rows = near_copies(seed, groups=20, unrelated=20) + short
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), rule=P.NEAR).collect()]
    want = brute(rows, 5, 4, 5)
    assert sorted(out, key=str) == want
    assert {k: c for k, _, c in want}[2001] == 2000


def test_the_stage_drops_short_near_copies(spark):
    base = [f"w{i}" for i in range(50)]
    copy = [*base[:25], "other", *base[26:]]  # 41 of 51 shingles of five words; 45 of 51 of three words
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, "else")], "doc_id long, text string")
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect()} == {1, 3}
    assert jaccard.one_of_each(docs).count() == 3


def test_rows_that_share_a_key_are_judged_by_their_texts(spark):
    copy, clean, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(3, copy), (5, copy), (5, clean), (5, clean), (6, other), (6, other + " end"), (7, None), (7, ""), (7, "x y"), (None, copy), (8, clean.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard.one_of_each(df, rule=P.NEAR)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in out.collect()), key=str)
    sixth = [t for k, t in got if k == 6]
    assert len(sixth) == 1 and sixth[0] in (other, other + " end")
    assert [g for g in got if g[0] != 6] == sorted([(3, copy), (5, clean), (7, ""), (7, "x y"), (None, copy)], key=str)
