"""Connected components over an edge table and over verified members of candidate buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrace.session import cut_and_release, cut_lineage
from llm.text import bit_filtered


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Each node's smallest neighbour comes from a map-side combined aggregate that is
    joined back, so the neighbours of a hub are never gathered into one row."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u > v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs, either order, loops and repeats allowed, to (id, component): the smallest
    id that is reachable. Ids without an edge to another id are absent. Rounds grow with the logarithm of
    the component size; each ends in a reliable checkpoint. The driver sees two numbers a round."""
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                          .distinct())
    seen = None
    while True:
        current = cut_lineage(_stars(_stars(current, True), False))
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = mark


def shared_keys(members: DataFrame) -> DataFrame:
    """(key, leader, id) of ``members`` (id, key) whose key several ids have; the leader is the smallest of them."""
    leaders = cut_lineage(members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
                          .where("leader < last").select("key", "leader"))
    return cut_lineage(bit_filtered(members, "key", leaders).join(leaders, "key"))


def linked_components(shared: DataFrame, verify: Callable[[DataFrame], DataFrame],
                      features: Callable[[DataFrame], DataFrame] | None = None, near: str = "", every_leader: bool = False,
                      across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``shared`` as of ``shared_keys``: ids with a common key may be linked; ``verify`` takes pairs (a, b), a < b, and
    returns those that are. ``features`` maps a table (id) to (id, columns) and ``near`` is a condition on the columns of
    two sides ``x`` and ``y`` that every link fulfils; instead of both, ``across`` may map the second round's members (key, id,
    component, largest) to its links (a, b). Result as of ``components``, over all pairs with a common key.

    Two rounds propose pairs. The first pairs each id with the bucket leader that shares most keys with it, or with each
    of its buckets' leaders if verifying is cheap (``every_leader``). The second takes only buckets that still hold several components and proposes every near pair across components. Pairs
    within a component cannot change the result: members of a bucket's largest component are not compared
    with each other, so a hot bucket of copies is never expanded, ``near`` is part of the join, and a pair comes from the
    first of its common keys alone.
    """
    met = shared.where("leader < id").groupBy("id", "leader").count()
    if every_leader:
        best = met.select(F.col("leader").alias("a"), F.col("id").alias("b"))
    else:
        best = (met.groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("a"))
                .select("a", F.col("id").alias("b")))
    first = cut_and_release(verify(cut_and_release(best)))
    reached = components(first)

    # every leader has met all of its bucket
    rest = shared.where("id <> leader") if every_leader else shared
    grouped = rest.select("key", "id").join(reached, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    largest = (grouped.groupBy("key", "component").count().groupBy("key")
               .agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("n"))
               .where("n > 1").select("key", "largest"))
    still_open = cut_and_release(grouped.join(largest, "key"))
    if across is not None:
        links = cut_and_release(across(still_open))
        # what nobody reads any more goes from disk with the next release
        del shared, rest, grouped, largest, still_open, met, best
        return components(first.union(links))
    keys = still_open.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    known = cut_lineage(features(still_open.select("id").distinct()).join(keys, "id"))
    full = still_open.join(known, "id")
    x, y = full.where("component <> largest").alias("x"), full.alias("y")
    pairs = (x.join(y, F.expr("x.key = y.key AND x.component <> y.component "
                              f"AND (y.component = y.largest OR x.id < y.id) AND {near} "
                              "AND x.key = element_at(array_intersect(x.keys, y.keys), 1)"))
             .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    return components(first.union(verify(cut_lineage(pairs))))
