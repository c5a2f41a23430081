"""Boosted trees against a plain version in numpy, and closed forms."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilscope.operators import boosting as B
from perilscope.session import job_folder


def brute(x, y, role, settings, edges):
    """Trees as nested tuples (feature, bin, left, right) or values, and the evaluation losses."""
    o = B.OBJECTIVES[settings.objective]
    bins = np.array([[sum(v > e for e in edges[f]) for f, v in enumerate(row)] for row in x])
    train, held = role == B.TRAIN, role == B.EVAL
    start = o.link(min(max(y[train].mean(), 1e-9), np.inf if settings.objective != "logistic" else 1 - 1e-9))
    margin = np.full(len(y), start)

    def soft(g):
        return np.sign(g) * max(abs(g) - settings.l1, 0)

    def score(g, h):
        return soft(g) ** 2 / (h + settings.l2) if h + settings.l2 > 0 else 0.0

    def worth(g, h):
        value = -soft(g) / (h + settings.l2)
        if settings.max_step is not None:
            value = min(max(value, -settings.max_step), settings.max_step)
        return settings.step * value

    def grow(rows, g, h, level):
        best = None
        for f in range(len(edges)):
            for b in range(len(edges[f])):
                low = rows[bins[rows, f] <= b]
                high = rows[bins[rows, f] > b]
                if min(len(low), len(high)) < max(settings.min_rows, 1) or min(h[low].sum(), h[high].sum()) < settings.min_curvature:
                    continue
                gain = (score(g[low].sum(), h[low].sum()) + score(g[high].sum(), h[high].sum()) - score(g[rows].sum(), h[rows].sum())) / 2
                gain -= settings.min_gain
                if gain > 1e-7 and (best is None or gain > best[0] + 1e-7):
                    best = (gain, f, b, low, high)
        if best is None or level == settings.max_depth:
            return worth(g[rows].sum(), h[rows].sum())
        return best[1], best[2], grow(best[3], g, h, level + 1), grow(best[4], g, h, level + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    trees, losses = [], []
    for _ in range(settings.rounds):
        losses.append(o.loss(margin[held], y[held]).mean())
        g, h = o.slopes(margin, y)
        trees.append(grow(np.flatnonzero(train), g, h, 0))
        margin = margin + np.array([value(trees[-1], row) for row in bins])
    losses.append(o.loss(margin[held], y[held]).mean())
    return trees, losses, o.mean(margin)


def nested(tree, k=0):
    if tree.feature[k] < 0:
        return tree.value[k]
    return tree.feature[k], tree.bin[k], nested(tree, tree.left[k]), nested(tree, tree.right[k])


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return abs(a - b) < 1e-5
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])


def data(objective, n=400, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), 2)
    signal = 0.8 * x[:, 0] - 0.5 * (x[:, 1] > 0.3) + 0.3 * x[:, 2] * x[:, 0]
    y = {
        "logistic": (r.random(n) < 1 / (1 + np.exp(-signal))).astype(float),
        "poisson": r.poisson(np.exp(signal / 2)).astype(float),
        "gamma": np.round(r.gamma(2, np.exp(signal) / 2) + 0.01, 4),
        "tweedie": np.round(r.gamma(2, np.exp(signal) / 2) * (r.random(n) < 0.4), 4),
    }[objective]
    return x, y, r.choice([B.TRAIN] * 6 + [B.EVAL] * 2 + [B.UNUSED], n)


def table(spark, x, y, role, parts=3, more_roles=(), **options):
    rows = [(k, [float(v) for v in row], float(t), *map(int, roles)) for k, (row, t, *roles) in enumerate(zip(x, y, role, *more_roles))]
    names = [f"r{k}" for k in range(1 + len(more_roles))]
    df = spark.createDataFrame(rows, "k long, x array<double>, y double, " + ", ".join(f"{c} int" for c in names))
    df = df.repartition(parts, F.rand(parts))
    return B.bin_rows(df, [f"f{k}" for k in range(len(x[0]))], F.col("x"), "y", [F.col(c) for c in names], F.xxhash64("k"), **options)


SETTINGS = {
    "logistic": B.TreeSettings("logistic", 3, 4, 0.3, l2=0.5, min_gain=0.1, min_rows=2),
    "poisson": B.TreeSettings("poisson", 2, 4, 0.3, l2=1, l1=1, min_curvature=5, max_step=0.7),
    "gamma": B.TreeSettings("gamma", 3, 3, 0.2, l2=1, l1=1, min_curvature=5),
    "tweedie": B.TreeSettings("tweedie", 2, 4, 0.2, l2=8, l1=1, min_gain=0.1, min_curvature=3),
}


@pytest.mark.parametrize("objective", list(SETTINGS))
def test_trees_are_those_of_a_plain_version(spark, objective, monkeypatch):
    monkeypatch.setattr(B, "REWRITE", 2)
    monkeypatch.setattr(B, "SLICE", 37)
    x, y, role = data(objective)
    binned = table(spark, x, y, role, bins=12)
    settings = SETTINGS[objective]
    other = B.replace(settings, max_depth=1, rounds=settings.rounds + 1, step=0.5)
    fitted = B.fit_boosted(binned, [settings, other])
    for model, s in zip(fitted.models, (settings, other)):
        trees, losses, predictions = brute(x, y, role, s, binned.edges)
        assert all(same(nested(a), b) for a, b in zip(model.trees, trees)) and len(model.trees) == len(trees)
        assert model.losses == pytest.approx(losses, abs=1e-6)
        assert model.predict(B.to_bins(x, binned.edges)) == pytest.approx(predictions, rel=1e-5)


def test_a_fit_is_the_same_on_any_layout(spark):
    x, y, role = data("logistic", 3000)
    s = B.TreeSettings("logistic", 4, 5, 0.2, l2=0.5, row_share=0.5, column_share=0.5, patience=3)
    fits = [B.fit_boosted(table(spark, x, y, role, parts, bins=30), [s]).models[0] for parts in (1, 7)]
    assert [t.value for t in fits[0].trees] == [t.value for t in fits[1].trees]
    assert [t.feature for t in fits[0].trees] == [t.feature for t in fits[1].trees] and fits[0].losses == fits[1].losses


def test_patience_keeps_the_best_trees(spark):
    x, y, role = data("logistic", 300, 9)
    y = np.random.default_rng(2).integers(0, 2, 300).astype(float)  # nothing to learn
    s = B.TreeSettings("logistic", 4, 12, 0.8, patience=2)
    binned = table(spark, x, y, role, bins=20)
    losses = B.fit_boosted(binned, [B.replace(s, patience=None)]).models[0].losses
    model = B.fit_boosted(binned, [s]).models[0]
    stop = next(k for k in range(len(losses)) if k - int(np.argmin(losses[: k + 1])) >= 2)
    assert stop < 12 and len(model.trees) == int(np.argmin(losses[: stop + 1]))
    assert min(model.losses) == model.losses[-1]


def test_folds_grow_in_the_same_scans(spark):
    x, y, role = data("poisson")
    second = np.where(role == B.EVAL, B.TRAIN, B.EVAL)
    binned = table(spark, x, y, role, more_roles=[second], bins=8)
    s = SETTINGS["poisson"]
    both = B.fit_boosted(binned, [s, B.replace(s, fold=1)])
    for model, roles in zip(both.models, (role, second)):
        trees, _, _ = brute(x, y, roles, s, binned.edges)
        assert all(same(nested(a), b) for a, b in zip(model.trees, trees))


def test_nulls_constants_and_no_rows(spark, tmp_path):
    rows = [(k, [None if k % 3 == 0 else float(k % 7), 5.0, float("nan")], float(k % 3 == 0), 0) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, x array<double>, y double, role int")
    binned = B.bin_rows(df, ["a", "b", "c"], F.col("x"), "y", [F.col("role")], F.xxhash64("k"), bins=8)
    assert len(binned.edges[1]) == 0 and len(binned.edges[2]) == 0
    fitted = B.fit_boosted(binned, [B.TreeSettings("logistic", 2, 2, 0.5)])
    assert fitted.models[0].trees[0].feature[0] == 0  # nulls are told apart by the lowest bin
    path = job_folder(spark, "trees")
    fitted.save(spark, path)
    again = B.BoostedTrees.load(spark, path)
    columns = [F.col("x")[k] for k in range(3)]
    both = df.select(fitted.prediction(columns).alias("a"), again.prediction(columns).alias("b"))
    assert both.where("a is null or a <> b").count() == 0 and both.agg(F.max("a") > 0.4, F.min("a") < 0.35).first() == (True, True)
    none = B.bin_rows(df.limit(0), ["a", "b", "c"], F.col("x"), "y", [F.col("role")], F.xxhash64("k"))
    empty = B.fit_boosted(none, [B.TreeSettings("poisson", 2, 1)])
    assert len(empty.models[0].trees) == 1 and empty.models[0].trees[0].feature == [-1]


def test_a_scan_is_one_shuffle_of_sums(spark):
    x, y, role = data("logistic", 200)
    binned = table(spark, x, y, role, bins=8)
    g = B._Growing(0, B.BoostedModel(B.EVENT, 0.0), tree=B.Tree(), open=[0], columns=[0, 1])
    plan = B._sums(binned.table, [g], [8] * 4, True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1


@pytest.mark.parametrize("largest", [1.0, 1e6])  # with the second, curvatures are too large to be packed
def test_sums_of_nodes_and_bins_are_exact(largest):
    r = np.random.default_rng(3)
    n, nodes, n_bins = 3000, 5, [1, 7, 255]
    bins = np.stack([r.integers(0, k, n) for k in n_bins]).astype(np.uint8)
    place = r.integers(0, nodes, n)
    g, h = np.rint(r.normal(size=n) * B.UNIT), np.rint(r.random(n) * largest * B.UNIT)
    totals = [np.zeros((3, nodes * k), dtype=np.int64) for k in n_bins]
    for _ in range(2):
        B._add_up(totals, [0, 1, 2], n_bins, bins, place, nodes, g, h)
    for f, k in enumerate(n_bins):
        want = np.zeros((3, nodes * k), dtype=np.int64)
        np.add.at(want, (slice(None), place * k + bins[f]), 2 * np.stack([g, h, np.ones(n)]).astype(np.int64))
        assert (totals[f] == want).all()


def test_blocks_are_full_and_earlier_margins_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(B, "REWRITE", 1)
    written = []
    keep = B.materialise
    monkeypatch.setattr(B, "materialise", lambda df, name: written.append(keep(df, name)) or written[-1])
    rows = spark.range(40_000, numPartitions=1).select(
        F.array((F.col("id") % 50).cast("double"), F.lit(1.0)).alias("x"), (F.col("id") % 50 > 20).cast("double").alias("y"), "id")
    binned = B.bin_rows(rows, ["a", "b"], F.col("x"), "y", [F.lit(B.TRAIN)], F.xxhash64("id"), edges=[[5.0, 20.0], []])
    assert binned.table.where(f"n < {B.SLICE}").count() <= binned.table.rdd.getNumPartitions()
    paths = lambda df: df.inputFiles()
    model = B.fit_boosted(binned, [B.TreeSettings(max_depth=2, rounds=3)]).models[0]
    assert [t.feature[0] for t in model.trees] == [0, 0, 0]
    local = [[p.removeprefix("file://") for p in paths(df)] for df in written]
    assert [all(os.path.exists(p) for p in part) for part in local] == [True] + [False] * (len(local) - 2) + [True]


def test_only_the_smaller_of_two_nodes_is_counted(spark):
    x, y, role = data("logistic", 600)
    binned = table(spark, x, y, role, bins=12)
    s = B.TreeSettings("logistic", 3, 1, 0.3)
    n_bins = [len(e) + 1 for e in binned.edges]
    g = B._Growing(0, B.BoostedModel(s, 0.0), tree=B.Tree(), open=[0], columns=[0, 1, 2, 3])
    tasks = binned.table.rdd.getNumPartitions()
    sizes = []
    for level in range(2):
        _, cuts = B._step(binned.table, tasks, [g], n_bins, False)
        B._extend(g, cuts[0], level)
        parts = B._sums(binned.table, [g], n_bins, False).collect()
        sizes.append(sum(len(r["sums"]) for r in parts) // tasks)
        assert len(g.open) == 2 * len(g.rest) == 2 * len(g.counted())
    # two sums of the loss, three per counted node and bin
    assert sizes == [8 * (2 + 3 * k * sum(n_bins)) for k in (1, len(g.counted()))]
    train, bins = np.flatnonzero(role == B.TRAIN), B.to_bins(x, binned.edges)
    ends = g.tree.nodes(bins, train)
    for one, other in zip(g.open[::2], g.open[1::2]):
        left, right = (int((ends == k).sum()) for k in (one, other))
        assert g.rest[g.open.index(one) // 2] == (other if left <= right else one)
    _, cuts = B._step(binned.table, tasks, [g], n_bins, False)
    assert g.sums[0, 2].sum(axis=1).tolist() == [int((ends == k).sum()) for k in g.open]


def test_beyond_a_few_tasks_the_sums_are_added_up_by_tasks(spark, monkeypatch):
    x, y, role = data("tweedie")
    s = SETTINGS["tweedie"]
    fits = []
    for most in (16, 2):
        monkeypatch.setattr(B, "FAN_IN", most)
        fits.append(B.fit_boosted(table(spark, x, y, role, 5, bins=12), [s]).models[0])
    assert fits[0] == fits[1]


def test_a_task_reads_few_blocks_at_once(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE", 10)
    rows = spark.range(4000, numPartitions=1).select(F.array(F.rand(1)).alias("x"), (F.col("id") % 2).cast("double").alias("y"), "id")
    binned = B.bin_rows(rows, ["a"], F.col("x"), "y", [F.lit(B.TRAIN)], F.xxhash64("id"))

    def run(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    found = [r["n"] for r in binned.table.mapInArrow(run, "n long").collect()]
    assert sum(found) >= 400 and max(found) <= 32
