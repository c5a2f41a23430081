"""The manifest against a plain tree in Python."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from perilscope.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        first = place // 3 * 3
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + 3])))
        place //= 3
    return out


def tampered(row):
    key = "" if row[0] is None else str(row[0])
    if zlib.crc32(key.encode()) % 2 or row[4] is None:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = grow([leaf(r) for r in groups[g]])
    upper = grow([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            proof = siblings(trees[g], i) + siblings(upper, k)
            folded = leaf(tampered(row))
            for a, b in proof:
                folded = h(a + folded + b)
            root = upper[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, h("".join(a + b for a, b in proof)), folded, folded == root,
                        tuple(a + b for a, b in proof)))
    return sorted(out, key=str)


def manifest(df, **options):
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    claim = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(df, claims={"text": claim}, with_siblings=True, **options).collect()
    return sorted(((*r[:-1], tuple(r[-1])) for r in map(tuple, found)), key=str)


def table(seed, n):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        source = r.choice(["hot"] * 6 + ["a", "é", "zz", "", None, f"s{r.randrange(9)}"])
        text = r.choice([None, "", "a\nb", "plain", "long " * r.randrange(200), "é\n\n" * 3])
        rows.append((r.choice([k, k, k, None, 7, 2**60 + k]), source, r.choice(["en", None]), r.choice([k, None]), text))
    return rows + rows[: n // 4] + [(7, "hot", "en", 1, "same\n")] * (n // 4)


@pytest.mark.parametrize("seed,n,depth", [(1, 60, 1), (2, 120, 2), (3, 40, 8)])
def test_against_a_plain_tree(spark, seed, n, depth):
    rows = table(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(seed))
    assert manifest(df, depth=depth) == brute(rows)


def test_small_tables_and_clashing_columns(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)) == []
    one = [(1, "a", None, None, None)]
    assert manifest(spark.createDataFrame(one, SCHEMA)) == brute(one)
    rows = [(k, f"s{k % 4}", "en", k, f"t\n{k}") for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "pos", "n", "digest", "claim", "key", "leaf", "root", "owner", "number", "subroot", "id"):
        df = df.withColumn(name, F.lit("x"))
    assert manifest(df, depth=1) == brute(rows)


def test_only_what_changed_is_not_verified(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert merkle.manifest(docs).where("not verified").count() == 0
    wrong = merkle.manifest(docs, claims={"lang": F.when(F.col("doc_id") == 3, "xx").otherwise(F.col("lang"))})
    assert [r["doc_id"] for r in wrong.where("not verified").collect()] == [3]
