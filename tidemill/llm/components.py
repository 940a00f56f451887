"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import join_counted, materialize


def components(links: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, root) for every node of the links (a, b): its component's smallest node.

    Rounds of large-star and small-star: each hangs nodes below the smallest
    neighbour known, until nothing changes, which takes a number of rounds that
    grows with the logarithm of the longest chain. Every round is written to the
    shared folder, so that a lost executor costs no earlier round.
    """
    edges = write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = sign(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a component's head has all of its members beside it
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both, least, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: all that is known of u, and u itself, goes below the smallest of it
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        following = write(small, "links")
        then = sign(following)
        edges = following
        if now == then:
            break
        now = then
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
