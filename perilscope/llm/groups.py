"""Bringing one row per group back to the group's members, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with at least this share of all members is sent to every task: there are so many at most.
HOT_GROUPS = 512


def join_groups(members: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``members`` with the columns of ``groups`` (one row per ``key``; ``size`` is its number of members).

    Groups with a 512th of all members or more are broadcast, 512 rows at most, so that none of them is
    dealt to one task; the others are joined by key. Null is a key like any other. A member whose key no group
    has is left out. ``members`` is read twice and should be a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    groups = groups.withColumnRenamed(key, "_group")
    is_hot = F.col(size) * HOT_GROUPS >= total
    hot = F.broadcast(groups.where(is_hot).drop(size))
    rest = groups.where(~is_hot).drop(size)
    same = F.col(key).eqNullSafe(F.col("_group"))
    large = members.join(hot, same).drop("_group")
    small = members.join(hot.select("_group"), same, "left_anti").join(rest, same).drop("_group")
    return large.unionByName(small)
