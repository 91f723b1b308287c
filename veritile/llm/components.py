"""Connected components of a graph of 64-bit nodes, by contraction."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritile.llm.common import discard, materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, rep) for each node of ``edges`` (columns ``u`` and ``v``, non-null longs); equal ``rep``: connected.

    In each round every node moves to the least of itself and its neighbours, in an order drawn anew, and the graph is
    relabelled.  At least about half of what is left of a path or star goes in a round, so rounds grow with the
    logarithm of the size.  Minima are partial aggregates, joins can be split by AQE where a node has many edges, and
    each round is written to the shared folder.
    """
    draw = random.Random(7)
    e = materialize(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        mask = F.lit(draw.getrandbits(63))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(mask)).alias("m"))
        to = materialize(least.select("u", F.least("m", F.col("u").bitwiseXOR(mask)).bitwiseXOR(mask).alias("rep")), "round")
        rounds.append(to)
        moved = (
            e.join(to, "u")
            .select(F.col("rep").alias("a"), F.col("v"))
            .join(to.select(F.col("u").alias("v"), F.col("rep").alias("b")), "v")
            .where(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        )
        e, done = materialize(moved.distinct(), "edges"), e
        discard(done)
    discard(e)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, rep long")
    labels = rounds[0].select(F.col("u").alias("node"), "rep")
    for to in rounds[1:]:
        step = to.select(F.col("u").alias("rep"), F.col("rep").alias("_next"))
        labels = labels.join(step, "rep", "left").select("node", F.coalesce("_next", "rep").alias("rep"))
    if len(rounds) > 1:
        labels = materialize(labels, "labels")
        discard(*rounds)
    return labels
