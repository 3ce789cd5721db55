"""Connected components by alternating large-star and small-star steps, each a shuffle, with the lineage cut after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): m is the least of a's b.  Minima are combined before the shuffle, so a vertex of many edges isn't one task's sort."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _both(pairs: DataFrame, *ways: tuple[str, str]) -> DataFrame:
    """(a, b) for each way of each of pairs; no union, as that would name pairs, and all that they come from, once for each."""
    return pairs.select(F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ways))).alias("x")).select("x.a", "x.b")


def _round(now: DataFrame) -> DataFrame:
    """Edges (a > b) after a large-star and a small-star step.  The plan reads now four times, whatever steps would be shared when it runs."""
    large = _with_least(_both(now, ("a", "b"), ("b", "a"))).withColumn("m", F.least("a", "m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # small star: to the least of the neighbours that aren't greater
    return _both(_with_least(large), ("b", "m"), ("a", "m")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component: its least id) of each vertex of edges (a long, b long); loops and repeated edges don't matter."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        now = cut(_round(now))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
