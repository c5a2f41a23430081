"""Languages whose rows are copies of one text, or all long texts, are learned."""

import random

from pyspark.sql import functions as F

from perilscope.llm import langid

POOLS = {
    "aa": "bravo brenta brisk bruno brodu brama".split(),
    "bb": "zelek zimny zolta zurek zadra zubry".split(),
    "cc": "quomo quaro quenti quillo quata quest".split(),
}


def test_copies_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 2000)
    r = random.Random(2)

    def text(label, n):
        return " ".join(r.choice(POOLS[label]) for _ in range(n))

    rows = [(text("aa", 20), "aa") for _ in range(200)]
    rows += [("zelek", "bb")] * 20_000 + [(text("bb", 20), "bb") for _ in range(40)]
    rows += [(text("cc", 900), "cc") for _ in range(30)]  # all longer than SAMPLE_BYTES
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda texts, labels, *a, **k: seen.append((texts, labels)) or fit(texts, labels, *a, **k))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = langid.train(docs, sample_docs=30)
    texts, labels = seen[0]
    assert model.languages == ["aa", "bb", "cc"] and [(labels == k).sum() for k in range(3)] == [30, 30, 30]
    assert len(set(texts)) == 90 and max(map(len, texts)) <= 2000
    assert all(w in POOLS["cc"] for t, k in zip(texts, labels) if k == 2 for w in t.split())
    new = [(label, " ".join(w[:-1] + "i" for w in text(label, 12).split())) for label in POOLS for _ in range(5)]
    judged = langid.identify(spark.createDataFrame(new, "want string, text string"), model)
    assert judged.where(F.col("want") != F.col("lang_pred")).count() == 0


def test_all_labels_long(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 400)
    rows = [(" ".join(POOLS[l][(i + j) % 6] for j in range(300)), l) for l in ("aa", "bb") for i in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    out = langid.identify(docs, langid.train(docs)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in out)
