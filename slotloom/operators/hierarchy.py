"""The resource tree: ancestors, depths, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.tables import SMALL, kept
from slotloom.schema import Limits, ScheduleError


def closure(resources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(id, ancestor_id, depth)``, each resource being its own ancestor at depth 0, up to one level beyond the limit.

    The links known so far reach ``2^k`` levels up; joined with those of their farthest ancestors they reach twice as far, so that a tree of
    50 levels takes six rounds, each written once. A parent that does not exist is listed as an ancestor but leads no further.
    """
    own = kept(resources.select("id", "parent_id"), "tree")
    inner = own.where("parent_id is not null").select(F.col("parent_id").alias("via")).distinct()
    few = inner.limit(SMALL + 1).count() <= SMALL // limits.depth
    out = own.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("depth")).unionByName(own.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")))
    reach = 1
    while (most := limits.depth + 1 - reach) > 0:
        far = out.where(F.col("depth") == reach).select("id", F.col("ancestor_id").alias("via"))
        # only what is somebody's parent can lead on, and it has a row for each level at most
        above = out.where(f"depth > 0 and depth <= {most}").select(F.col("id").alias("via"), "ancestor_id", "depth").join(inner, "via", "left_semi")
        links = kept(far.join(F.broadcast(above) if few else above, "via").select("id", "ancestor_id", (F.col("depth") + reach).alias("depth")), "links")
        if links.isEmpty():
            break
        out = out.unionByName(links)
        reach *= 2
    return out


def tree_errors(resources: DataFrame, tree: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(id, error)``: resources above which the tree turns in a circle, is too deep, or lacks a parent, in this order."""
    seen = tree.groupBy("id", "ancestor_id").count().where("count > 1").select("id").distinct().select("id", F.lit("CycleDetected").alias("error"), F.lit(0).alias("o"))
    deep = tree.where(F.col("depth") > limits.depth).select("id").distinct().select("id", F.lit("LimitExceeded: hierarchy too deep").alias("error"), F.lit(1).alias("o"))
    lost = tree.join(resources.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_anti").select("id").distinct().select("id", F.lit("NotFound").alias("error"), F.lit(2).alias("o"))
    return seen.unionByName(deep).unionByName(lost).groupBy("id").agg(F.min_by("error", "o").alias("error"))


def checked_tree(resources: DataFrame, ids: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """The closure (of ``ids``). What ``tree_errors`` finds in it is raised, the first by id."""
    tree = closure(resources, limits)
    if ids is not None:
        tree = tree.where(F.col("id").isin(ids))
    known = tree.where("depth = 0").select(F.col("id").alias("ancestor_id")) if ids is None else resources.select(F.col("id").alias("ancestor_id"))
    # a circle is also too deep, so that these two conditions find all faults
    if not tree.where(F.col("depth") > limits.depth).limit(1).unionByName(tree.join(known, "ancestor_id", "left_anti").limit(1)).isEmpty():
        bad = tree_errors(resources, tree, limits).orderBy("id").first()
        raise ScheduleError(bad["error"], bad["id"])
    return tree


def depths(tree: DataFrame) -> DataFrame:
    """``(id, depth)``: how many ancestors each resource has."""
    return tree.groupBy("id").agg(F.max("depth").alias("depth"))


def has_children(resources: DataFrame) -> DataFrame:
    """The resources that are somebody's parent."""
    return resources.join(resources.where("parent_id is not null").select(F.col("parent_id").alias("id")), "id", "left_semi")
