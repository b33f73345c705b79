"""From buckets of candidates to links and components, without forming all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components


def members_of(rows: DataFrame, scratch: Scratch, name: str = "members") -> DataFrame:
    """(rep, first, n) of the buckets of (rep, band) rows that hold several: smallest member, most members of such a bucket."""
    buckets = rows.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n")).where("first <> last").select("band", "first", "n")
    met = rows.join(buckets, "band").groupBy("first", "rep").agg(F.max("n").alias("n"))
    return scratch.save(met, name)


def grown(found: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components (node, component) after ``links`` (a, b) were added to those of ``found``: only components are linked anew."""
    if found is None:
        return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch, name)
    a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    moved = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst"))
    onto = connected_components(moved, scratch, name)
    old = found.join(onto.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    # nodes that were in no component before; one of them may be the name of a component
    return scratch.save(old.unionByName(onto.join(found.select("node"), "node", "left_anti")), f"{name}-grown")


def link_members(
    members: DataFrame,
    features: DataFrame,
    screen: Callable[[Column, Column], Column],
    confirm: Callable[[DataFrame], DataFrame],
    residue: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    name: str = "link",
) -> DataFrame | None:
    """Components (node, component) of the links among ``members``, None without links.

    ``features`` has one row (rep, feature) for each member; ``screen`` says of two features whether the pair is worth
    confirming; ``confirm`` keeps those of a table of pairs (a, b) that are linked; ``residue`` proposes pairs (a, b)
    within groups (pivot, rep, apart), of which one at least is apart, that is, not linked to the pivot.

    1. Members meet the least of the firsts of their buckets; then those of these firsts that aren't in their component.
    2. All buckets whose firsts are in one component form one group, its smallest member being the pivot.  Members
       that aren't of the pivot's component yet meet the pivot.
    3. Members that are still apart are compared with the rest of their group by what sets them off from the pivot
       (``residue``): what a whole group has in common never makes a pair.
    """
    found: DataFrame | None = None
    feature_a = features.select(F.col("rep").alias("a"), F.col("feature").alias("fa"))
    feature_b = features.select(F.col("rep").alias("b"), F.col("feature").alias("fb"))

    def settle(pairs: DataFrame, i: int) -> None:
        nonlocal found
        # the left side names whole groups and can be hot: Spark splits it
        some = pairs.join(feature_b, "b").join(feature_a, "a").where(screen(F.col("fa"), F.col("fb"))).select("a", "b")
        some = scratch.save(some, f"{name}-pairs{i}")
        if some.isEmpty():
            return
        new = scratch.save(confirm(some), f"{name}-links{i}")
        if not new.isEmpty():
            found = grown(found, new, scratch, f"{name}-cc{i}")

    def placed(rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with the component of each of ``columns`` in of_<column>."""
        for c in columns:
            if found is None:
                rows = rows.withColumn(f"of_{c}", F.col(c))
            else:
                rows = rows.join(found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
        return rows

    settle(members.where("rep <> first").groupBy(F.col("rep").alias("b")).agg(F.min("first").alias("a")).select("a", "b"), 0)
    if found is not None:
        others = placed(members.where("rep <> first").select("first", "rep"), "first", "rep").where("of_first <> of_rep")
        settle(others.select(F.col("first").alias("a"), F.col("rep").alias("b")), 1)
    else:
        settle(members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")), 1)
    state = placed(members.where("n > 2").select("first", "rep"), "first", "rep")
    grouped = state.select(F.col("of_first").alias("pivot"), "rep", (F.col("of_first") != F.col("of_rep")).alias("apart"), (F.col("first") == F.col("of_first")).alias("met"))
    grouped = scratch.save(grouped.groupBy("pivot", "rep").agg(F.max("apart").alias("apart"), F.max("met").alias("met")), f"{name}-groups")
    open_ = grouped.where("apart").select("pivot").distinct()
    if open_.isEmpty():
        return found
    grouped = scratch.save(grouped.join(open_, "pivot", "left_semi"), f"{name}-open")
    settle(grouped.where("apart and not met and pivot <> rep").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct(), 2)
    state = placed(grouped.where("pivot <> rep").select("pivot", "rep"), "pivot", "rep").withColumn("apart", F.col("of_pivot") != F.col("of_rep"))
    state = scratch.save(state, f"{name}-state")
    if state.where("apart").isEmpty():
        return found
    # a single member has met the pivot
    open_ = state.groupBy("pivot").agg(F.max("apart").alias("apart"), F.count("*").alias("n")).where("apart and n > 1").select("pivot")
    pairs = residue(state.join(open_, "pivot", "left_semi").select("pivot", "rep", "of_rep", "apart"))
    settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), 3)
    return found
