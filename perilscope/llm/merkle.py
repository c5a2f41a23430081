"""A Merkle manifest of a table, with a proof for every row.

Rows become leaves; per group (a source) the leaves in key order are hashed in runs of ``fanout``
until one node is left, the group's subroot; the subroots in group order give the root in the same way.

Leaves are numbered by a range-partitioned sort. Every ``fanout ** depth`` consecutive leaves of a group
are a superblock. A first exchange reduces each superblock to its top node; the top nodes are the leaves of a
tree a few thousand times smaller, which is treated in the same way until one node is left. On the way
back the leaves and the outer nodes their superblock needs are cogrouped by superblock: the task that holds them
finishes the local reduction, joins the proofs and folds them. A group of any size is so dealt over many
tasks, small groups share a superblock, and nothing but the root reaches the driver.

The digest of a row is H (sha256 as lowercase hex) of its fields one after the other: ``-`` for null, else
the number of UTF-8 bytes, ``:`` and the value.

Defined results: a null group is a group of its own, before all others; leaves of one key are ordered by
their digest, and rows that are equal in every field are separate leaves; a null key comes first. A node
that is alone in its run is hashed again, a single leaf is its group's subroot and a single subroot the root. No
rows give no rows. Other columns of the table play no part. Very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilscope.session import materialise

FANOUT = 3
DEPTH = 8  # levels inside a superblock: 6,561 leaves


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of the fields of a row."""
    parts = []
    for field in fields:
        value = field.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Tree:
    """The levels of the trees of all groups, from the leaves up.

    Level 0 has ``grp, pos, n, digest`` (and what its rows carry); a level's ``tops`` hold one row per superblock
    with its place and number among those of its group: where there are several, they are the next level.
    """

    fanout: int
    depth: int
    levels: list[DataFrame]
    tops: list[DataFrame]

    @property
    def block(self) -> int:
        return self.fanout**self.depth

    def roots(self) -> DataFrame:
        """``grp`` and ``digest`` of the last node of every group."""
        parts = [t.where("n = 1").select("grp", "digest") for t in self.tops]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _dealt(nodes: DataFrame, pos: str, several: Column, blocks: int) -> DataFrame:
    """The superblock of every row: part of one large group, or a bucket of whole small ones."""
    return nodes.withColumns(
        {
            "owner": F.when(several, F.concat(F.lit("g"), F.col("grp"))).otherwise(F.lit("s")),
            "number": F.when(several, F.expr(pos)).otherwise(F.pmod(F.xxhash64("grp"), F.lit(blocks))),
        }
    )


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``n``, the number of rows, in each ``grp``.

    ``rows`` is a written table: the place in its scan tells equal rows apart, so that no key, repeated however
    often, is bound to one task. Only counts of tasks' stretches are joined to the sorted rows.
    """
    keys = ["grp", *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    in_order = ranged.sortWithinPartitions(*keys).drop("_tie")
    table = materialise(in_order.withColumn("_row", F.monotonically_increasing_id()), name)
    table = table.withColumn("_task", F.shiftright("_row", 33))
    stretches = table.groupBy("grp", "_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        "grp", "_task", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"),
    )
    placed = table.join(stretches, ["grp", "_task"])
    return placed.withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first")).drop(
        "_task", "_row", "_first", "_before"
    )


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _grow(digests: list[str], n: int, fanout: int, depth: int) -> list[list[str]]:
    """The levels over a stretch of a group of ``n`` nodes: ``depth`` of them, fewer where it is the whole group."""
    levels = [digests]
    whole = n <= fanout**depth
    while len(levels) <= depth and not (whole and len(levels[-1]) == 1):
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def _stretches(nodes: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in nodes.groupby("grp", sort=False):
        yield part.sort_values("pos", kind="stable")


def build(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> Tree:
    """The trees over numbered nodes (``grp, pos, n, digest``)."""
    size = fanout**depth
    tree = Tree(fanout, depth, [], [])

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _stretches(block):
            n, first = int(part["n"].iloc[0]), int(part["pos"].iloc[0])
            top = _grow([d.hex() for d in part["digest"]], n, fanout, depth)[-1][0]
            out.append((part["grp"].iloc[0], first // size, -(-n // size), bytes.fromhex(top)))
        return pd.DataFrame(out, columns=["grp", "pos", "n", "digest"])

    while True:
        blocks = 1 + nodes.count() // size
        dealt = _dealt(nodes.select("grp", "pos", "n", "digest"), f"pos div {size}", F.col("n") > size, blocks)
        tops = dealt.groupBy("owner", "number").applyInPandas(reduce, "grp string, pos long, n long, digest binary")
        tops = materialise(tops, "merkle-tops")
        tree.levels.append(nodes)
        tree.tops.append(tops)
        nodes = tops.where("n > 1")
        if nodes.head() is None:
            return tree


def _paths(tree: Tree, level: int, outer: DataFrame) -> DataFrame:
    """The proofs of a level's nodes: ``left`` and ``right`` siblings per step, the outer steps last.

    ``outer`` has the proof of every superblock's top node: ``grp, pos, several, left, right, subroot``.
    """
    fanout, depth, size = tree.fanout, tree.depth, tree.block

    def join(nodes: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, steps, above in _inside(nodes, around, fanout, depth):
            grp, first = part["grp"].iloc[0], int(part["pos"].iloc[0])
            for i in range(len(part)):
                own = _siblings(steps, i, fanout)
                out.append((
                    grp, first + i, [a for a, _ in own] + list(above["left"]), [b for _, b in own] + list(above["right"]),
                    above["subroot"],
                ))
        return pd.DataFrame(out, columns=["grp", "pos", "left", "right", "subroot"])

    schema = "grp string, pos long, left array<string>, right array<string>, subroot string"
    return _cogrouped(tree.levels[level].select("grp", "pos", "n", "digest"), outer, size).applyInPandas(join, schema)


def _cogrouped(nodes: DataFrame, outer: DataFrame, size: int):
    blocks = 1 + nodes.count() // size
    inner = _dealt(nodes, f"pos div {size}", F.col("n") > size, blocks)
    around = _dealt(outer, "pos", F.col("several"), blocks)
    return inner.groupBy("owner", "number").cogroup(around.groupBy("owner", "number"))


def _inside(nodes: pd.DataFrame, around: pd.DataFrame, fanout: int, depth: int):
    """Every stretch of a superblock with its levels and the proof of its top node."""
    proofs = {row["grp"]: row for _, row in around.iterrows()}
    for part in _stretches(nodes):
        levels = _grow([d.hex() for d in part["digest"]], int(part["n"].iloc[0]), fanout, depth)
        yield part, levels[:-1], proofs[part["grp"].iloc[0]]


def _siblings(steps: list[list[str]], place: int, fanout: int) -> list[tuple[str, str]]:
    out = []
    for step in steps:
        first = place - place % fanout
        out.append(("".join(step[first:place]), "".join(step[place + 1 : first + fanout])))
        place //= fanout
    return out


def _down(tree: Tree, roots: DataFrame) -> DataFrame:
    """The outer proofs for level 0; ``roots`` has the proof of every group's last node."""
    outer = None
    for level in reversed(range(len(tree.levels))):
        ended = tree.tops[level].where("n = 1").select("grp").join(roots, "grp")
        ended = ended.select("grp", F.lit(0).cast("long").alias("pos"), F.lit(False).alias("several"), "left", "right", "subroot")
        outer = ended if outer is None else outer.unionByName(ended)
        if level:
            paths = _paths(tree, level, outer)
            outer = paths.select("grp", "pos", F.lit(True).alias("several"), "left", "right", "subroot")
    return outer


OUTPUT = "id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "source",
    claims: dict[str, Column] | None = None,
    with_siblings: bool = False,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per row of ``docs``: ``key, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``claims`` replaces fields by what somebody else holds for them; the leaf of that is folded with the proof,
    and ``verified`` tells whether the root comes out. ``proof_sha256`` is H of the siblings, level by level from
    the leaf to the root, each level's from left to right; ``with_siblings`` adds them as a list with one text per
    level.
    """
    kept = [F.col(f) for f in fields]
    claimed = [(claims or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        F.concat(F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("grp"),
        F.col(key).alias("key"),
        F.unhex(leaf_digest(kept)).alias("digest"),
        F.unhex(leaf_digest(claimed)).alias("claim"),
    )
    leaves = materialise(leaves, "merkle-leaves")
    tree = build(numbered(leaves, ["key", "digest"], "merkle-sorted"), fanout, depth)

    subroots = materialise(tree.roots().select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest"), "merkle-subroots")
    upper = build(numbered(subroots, ["member"], "merkle-subroots"), fanout, depth)
    top = upper.roots().first()
    root = top["digest"].hex() if top else None

    nothing = F.array().cast("array<string>")
    summit = upper.roots().select("grp", nothing.alias("left"), nothing.alias("right"), F.lit(None).cast("string").alias("subroot"))
    paths = _paths(upper, 0, _down(upper, summit))
    members = upper.levels[0].select("pos", F.col("member"), F.lower(F.hex("digest")).alias("subroot"))
    roots = paths.drop("subroot", "grp").join(members, "pos").select(F.col("member").alias("grp"), "left", "right", "subroot")
    outer = _down(tree, materialise(roots, "merkle-proofs"))

    def finish(nodes: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, steps, above in _inside(nodes, around, fanout, depth):
            beyond = list(zip(above["left"], above["right"]))
            rest = "".join(a + b for a, b in beyond)
            for i, (name, digest, claim) in enumerate(zip(part["id"], part["digest"], part["claim"])):
                own = _siblings(steps, i, fanout)
                folded = claim.hex()
                for a, b in own:
                    folded = _hash(a + folded + b)
                for a, b in beyond:
                    folded = _hash(a + folded + b)
                row = (name, digest.hex(), above["subroot"], _hash("".join(a + b for a, b in own) + rest), folded)
                out.append(row + ([a + b for a, b in own + beyond],) if with_siblings else row)
        columns = ["id", "leaf", "subroot", "proof_sha256", "folded_root"] + (["siblings"] if with_siblings else [])
        return pd.DataFrame(out, columns=columns)

    # the key travels as text: pandas would turn integers with a null among them into floating point
    nodes = tree.levels[0].select("grp", "pos", "n", "digest", "claim", F.col("key").cast("string").alias("id"))
    schema = OUTPUT + (", siblings array<string>" if with_siblings else "")
    found = _cogrouped(nodes, outer, tree.block).applyInPandas(finish, schema)
    return found.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "leaf", "subroot", F.lit(root).cast("string").alias("root"),
        "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"),
        *(["siblings"] if with_siblings else []),
    )
