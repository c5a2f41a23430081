"""Chains, the language model and language identification."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.llm import chain, hmm, langid

LOWER = {c: c + 32 for c in range(65, 91)}


def slow_chain(potential, transition, initial):
    n, s = potential.shape
    alpha = np.zeros((n, s))
    alpha[0] = initial * potential[0]
    for t in range(1, n):
        alpha[t] = alpha[t - 1] @ transition * potential[t]
    beta = np.ones((n, s))
    for t in range(n - 2, -1, -1):
        beta[t] = transition @ (potential[t + 1] * beta[t + 1])
    total = alpha[-1].sum()
    moves = sum(np.outer(alpha[t - 1], potential[t] * beta[t]) * transition / total for t in range(1, n)) if n > 1 else np.zeros((s, s))
    return math.log(total), alpha * beta / total, moves


@pytest.mark.parametrize("states", [1, 3])
def test_blocks_equal_the_plain_recursions(states):
    r = np.random.default_rng(states)
    transition = r.random((states, states))
    transition /= transition.sum(axis=1, keepdims=True)
    initial = r.random(states)
    first = np.array([0, 0, 1, 33, 33, 150, 182, 214, 215])
    potential = r.random((215, states)) + 0.01
    total, gamma, moves, begun = chain.Blocks(first).posteriors(potential, transition, initial)
    want_moves, want_begun = np.zeros((states, states)), np.zeros(states)
    for k, (a, b) in enumerate(zip(first, first[1:])):
        if a == b:
            assert total[k] == 0
            continue
        t, g, m = slow_chain(potential[a:b], transition, initial)
        assert np.isclose(total[k], t) and np.allclose(gamma[a:b], g)
        want_moves += m
        want_begun += g[0]
    assert np.allclose(moves, want_moves) and np.allclose(begun, want_begun)
    assert np.allclose(chain.Blocks(first).likelihood(potential, transition, initial), total)


def test_a_long_sequence_neither_underflows_nor_is_cut():
    potential = np.full((200_000, 2), 1e-30)
    total = chain.Blocks(np.array([0, 200_000])).likelihood(potential, np.full((2, 2), 0.5), np.array([0.5, 0.5]))
    assert np.isclose(total[0], 200_000 * math.log(1e-30))


def rows():
    r = random.Random(3)
    pools = [["the", "and", "of", "Thing", "rare%d"], ["le", "et", "de", "chose", "rare%d"]]
    out = []
    for i in range(300):
        pool = pools[i % 2]
        out.append((i, " ".join(r.choice(pool) if r.random() < 0.9 else f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 60)))))
    return out + [(5, None), (None, "the and"), (7, ""), (9, out[9][1]), (400, "the of " * 20_000), (401, " \t\n")]


def frame(spark, data):
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    return spark.createDataFrame([(k, t, 0.0) for k, t in data], "doc_id long, text string, score double").withColumn("train", key)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


@pytest.mark.parametrize("max_words", [4, 10_000])
def test_figures_of_the_language_model(spark, max_words):
    data = rows()
    train = [t for k, t in data if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = hmm.score_texts(frame(spark, data), max_words=max_words).collect()
    assert len(out) == len(data)
    want = Counter()
    for k, t in data:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[k, len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    assert want == Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    held = [r for r in out if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_baum_welch_never_lowers_the_likelihood():
    r = np.random.default_rng(1)
    bounds = np.arange(0, 2001, 50)
    symbols = np.concatenate([r.choice(6, 50, p=p) for p in ([.4, .4, .1, .1, 0, 0], [0, 0, .1, .1, .4, .4]) * 20])
    share = np.bincount(symbols, minlength=6) / len(symbols)
    model, before = hmm.Model.start(share, 2, 4), -np.inf
    for _ in range(8):
        now = model.log10_likelihood(symbols, bounds).sum()
        assert now > before - 20  # the prior may cost a little
        before, model = now, hmm.Model.of(*model.expected(symbols, bounds), share)
        assert np.allclose(model.emission.sum(axis=0), 1) and np.allclose(model.transition.sum(axis=1), 1)
    assert before > (np.log10(share)[symbols]).sum()


def test_words_beyond_the_symbols_learn_their_states(spark):
    """Two kinds of texts with words of their own, none of them frequent: the classes tell the kinds apart."""
    r = random.Random(7)
    data = [(i, " ".join(f"{'ab'[i % 2]}{r.randint(0, 150)}" for _ in range(40))) for i in range(400)]
    docs = frame(spark, data)
    held = {}
    for classes in (1, hmm.CLASSES):
        whole, hmm.CLASSES = hmm.CLASSES, classes
        try:
            out = hmm.score_texts(docs, max_words=0, states=2, rounds=8, tolerance=0.0).collect()
        finally:
            hmm.CLASSES = whole
        held[classes] = sum(x["score"] for x in out if not x["train"]) / sum(not x["train"] for x in out)
    assert held[hmm.CLASSES] > held[1] + 1, held


def test_classes_cover_every_hash():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)
    for n in (1, 2, 64, hmm.CLASSES):
        of = hmm.class_of(hashes, n)
        assert of.min() >= 0 and of.max() < n and len(np.unique(of)) > 0.4 * min(n, len(hashes))


def test_the_model_sums_to_one_over_short_texts():
    share = np.array([0.3, 0.2, 0.5])
    model = hmm.Model.start(share, 2, 1)
    pairs = np.array([[a, b] for a in range(3) for b in range(3)]).reshape(-1)
    total = (10 ** model.log10_likelihood(pairs, np.arange(0, 19, 2))).sum()
    assert np.isclose(total, 1)


def test_language_model_without_training_and_without_rows(spark):
    docs = frame(spark, rows()[:6])
    out = hmm.score_texts(docs.withColumn("train", F.lit(False))).collect()
    assert len(out) == 6 and {(r["train_tokens"], r["n_known"]) for r in out} == {(0, 0)}
    assert all(math.isfinite(r["score"]) and abs(r["base_score"]) < 1e-9 for r in out)
    assert hmm.score_texts(docs.limit(0)).count() == 0


# --- language identification ----------------------------------------------------

EN = "the thing that was of nothing ing with and this shall whether".split()
DE = "der die nicht schön geworden über eine zwischen heit keit ungern".split()


def labelled(n=160):
    r = random.Random(5)
    return [(i, " ".join(r.choice(DE if i % 2 else EN) for _ in range(r.randint(4, 40))), "de" if i % 2 else "en", "x") for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    data = labelled() + [(900, None, "en", "x"), (901, "unlabelled", None, "x"), (902, "", "de", "x")]
    return langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string, score string"))


def test_languages_of_new_texts(spark, model):
    r = random.Random(8)
    texts = [" ".join(r.choice(pool) for _ in range(12)) for pool in (EN, DE) * 20]
    odd = [None, "", "123 --- 4", "€ ٣", "日本", "Thing " * 30_000, texts[0]]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts + odd)], "doc_id long, text string, lang_pred int")
    out = {x["doc_id"]: x for x in langid.identify(docs, model).collect()}
    assert len(out) == len(texts) + len(odd)
    assert [out[i]["lang_pred"] for i in range(40)] == ["en", "de"] * 20
    assert [out[40 + i]["lang_pred"] for i in range(4)] == ["und"] * 4 and [out[40 + i]["score"] for i in range(4)] == [0.0] * 4
    assert out[44]["lang_pred"] in ("en", "de") and out[45]["lang_pred"] == "en"
    assert (out[46]["lang_pred"], out[46]["score"]) == (out[0]["lang_pred"], out[0]["score"])
    assert all(0 <= x["score"] <= 1 for x in out.values())


def test_words_of_mixed_texts_are_labelled_in_pieces(model):
    from perilscope.llm import words as W
    import pyarrow as pa

    text = " ".join(EN[:8] + DE[:8])
    data, offsets = W.buffer(pa.array([text], pa.large_string()))
    gamma, letter, _ = model.label(data, offsets)
    assert letter.all()
    found = [model.languages[k] for k in gamma.argmax(axis=1)]
    assert found == ["en"] * 8 + ["de"] * 8
    assert model.transition[0, 0] > model.transition[0, 1]


def test_without_labels_everything_is_unknown(spark):
    docs = spark.createDataFrame([(1, "the thing", None)], "doc_id long, text string, lang string")
    nothing = langid.train(docs)
    assert nothing is None and langid.identify(docs, nothing).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0), nothing).count() == 0


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    from perilscope.llm.queries import op9_language_id, read

    out = op9_language_id(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
