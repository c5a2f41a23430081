import hashlib

import pytest
from pyspark.sql import functions as F

from perilscope.operators import sampling as S


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def keys(df):
    return sorted(row["k"] for row in df.select("k").collect())


@pytest.mark.parametrize("n", [0, 1, 7, 10, 5000])
@pytest.mark.parametrize("fraction", [0.0, 0.9, 1.0])
def test_split_sizes_are_exact(spark, n, fraction):
    train, rest = S.split(ids(spark, n), "k", fraction)
    a, b = keys(train), keys(rest)
    assert len(a) == int(fraction * n)
    assert sorted(a + b) == list(range(n))


def test_search_goes_deeper_when_prefixes_stay_large(spark, monkeypatch):
    monkeypatch.setattr(S, "DIGITS", 1)
    train, rest = S.split(ids(spark, 3000), "k", 0.9)
    assert (train.count(), rest.count()) == (2700, 300)


def test_a_repeated_key_at_the_cut_is_refused(spark):
    repeated = ids(spark, 99).union(ids(spark, 1).crossJoin(spark.range(3000)).select("k"))
    with pytest.raises(ValueError, match="does not identify a row"):
        S.split(repeated, "k", 0.5)
    train, rest = S.split(repeated, "k", 1.0)
    assert (train.count(), rest.count()) == (3099, 0)


def test_split_does_not_depend_on_partitioning(spark):
    df = ids(spark, 2000)
    a, _ = S.split(df, "k", 0.9)
    b, _ = S.split(df.repartition(7, F.rand(1)), "k", 0.9)
    assert keys(a) == keys(b)
    c, _ = S.split(df, "k", 0.9, seed=124)
    assert keys(a) != keys(c)


def test_bags_are_independent_and_exact(spark):
    seeds = {f"bag_{i}": 123 + i for i in range(1, 6)}
    row = S.with_bag_flags(ids(spark, 1000), "k", 0.9, seeds).agg(
        *[F.sum(F.col(b).cast("int")).alias(b) for b in seeds]
    ).first()
    assert list(row) == [900] * 5


def test_sample_is_ordered_and_same_as_large_sample(spark):
    df = ids(spark, 3000)
    small = [row["k"] for row in S.sample_rows(df, "k", 100).collect()]
    assert small == sorted(small) and len(set(small)) == 100
    assert keys(S.large_sample(df, "k", 100)) == small
    assert keys(S.large_sample(df, "k", 10_000)) == list(range(3000))


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_index_is_dense(spark, monkeypatch, digits):
    monkeypatch.setattr(S, "INDEX_DIGITS", digits)
    index = S.hash_index(ids(spark, 5000), "k", 9)
    assert index.size == 5000
    whole = {r["_index"]: r["k"] for r in index.all_rows().collect()}
    assert sorted(whole) == list(range(5000))
    wanted = spark.createDataFrame([(i,) for i in (0, 7, 7, 4999, 2500)], "_index long")
    some = {r["_index"]: r["k"] for r in index.rows(wanted).collect()}
    assert some == {i: whole[i] for i in (0, 7, 2500, 4999)}


@pytest.mark.parametrize("n", [0, 1, 3, 10, 40])
def test_first_rows(spark, n):
    values = [5, 3, None, 3, 2**60 + 1, -4, 2**60, None, 9, 1]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k long, i int").repartition(3)
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    assert [r["k"] for r in S.first_rows(df, "k", n).collect()] == ordered[:n]
    named = df.select(F.col("k").cast("string").alias("k"))
    assert S.first_rows(named, "k", n).count() == min(n, 10)


def test_first_rows_of_sparse_keys(spark):
    keys = [-1_000_000, *range(1, 50)]
    for n in (1, 2, 3, 49, 50, 60):
        df = spark.createDataFrame([(k,) for k in keys], "k long")
        assert [r["k"] for r in S.first_rows(df, "k", n).collect()] == sorted(keys)[:n]
    wide = [2**60 + k for k in range(5)] + [-(2**61), 0, None]
    df = spark.createDataFrame([(k,) for k in wide], "k long")
    ordered = sorted(wide, key=lambda k: (k is not None, k or 0))
    for n in range(1, 9):
        assert [r["k"] for r in S.first_rows(df, "k", n).collect()] == ordered[:n]


@pytest.mark.parametrize("listed", [0, 20, 10_000])
def test_cuts_are_those_of_sorted_digests(spark, monkeypatch, listed):
    monkeypatch.setattr(S, "LISTED", listed)
    seeds = [5, 6, 7]
    found = S.cut_digests(ids(spark, 3000), "k", lambda n: n // 3, seeds)
    assert found == [sorted(hashlib.md5(f"{s}:{k}".encode()).hexdigest() for k in range(3000))[999] for s in seeds]


def test_prefixes_are_counted_without_a_sort(spark, monkeypatch):
    plans = []
    keep = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    S.cut_digests(ids(spark, 500), "k", lambda n: n // 2, [1, 2])
    assert len(plans) == 2 and all("Sort" not in plan and "HashAggregate" in plan for plan in plans)
