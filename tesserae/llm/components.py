"""Connected components by alternating large and small stars, for edge lists of any size.

A large star links each node's larger neighbours to the least node of its neighbourhood, a small star its smaller
ones; rounds repeat until the edges stay the same, which takes about log of the longest path. Every round is cut
off by a checkpoint in the shared folder, so that lost executors cost no more than a round. A node with a large share
of all edges (a hub, and every large component ends as one) would be one task of a plain join: `with_least` deals
its edges out.

Defined results: edges from a node to itself and edges with a null end are left out; repeated edges count once; no
edges give no rows. Node ids may be of any type that orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import checkpoint_ready

#: A key of more rows than this, and than this share of all rows, is dealt out; so there are at most MOST_HOT such keys.
LEAST_HOT, MOST_HOT = 1024, 10_000
#: Least neighbours are broadcast while the pairs, which are counted, are no more than this, and their ids are numbers.
BROADCAST_PAIRS = 131_072


def with_least(pairs: DataFrame, key: str, value: str, total: int, n: int = 1, most: int | None = None) -> DataFrame:
    """(key, value, least): the pairs of keys with n pairs or more, and the least value of their key.

    total: the number of pairs, or more; most: no key has more pairs, if that is known. A hot key's pairs go to as many
    places as they fill, and its least value to each of them. Hot keys are broadcast: each holds more than one in
    MOST_HOT of all pairs, so they are at most that many. Where no key can be hot a plain join does, and where pairs are
    few the least values are broadcast and nothing is dealt.
    """
    size, fixed = max(LEAST_HOT, total // MOST_HOT), {kind for _, kind in pairs.select(key, value).dtypes} <= {"bigint", "int", "smallint", "tinyint"}
    if most is not None and (most <= size or (total <= BROADCAST_PAIRS and fixed)):
        least = pairs.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("least"))
        return pairs.join(F.broadcast(least) if total <= BROADCAST_PAIRS and fixed else least, F.col(key) == F.col("__key")).select(key, value, "least")
    low = pairs.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("least"), F.count(value).alias("__n")).filter(F.col("__n") >= n)
    parts = F.ceil(F.col("__n") / size).cast("int")
    hot = low.filter(F.col("__n") > size).select(F.col("__key").alias("__hot"), parts.alias("__parts"))
    dealt = pairs.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__at", F.coalesce(F.pmod(F.xxhash64(value), F.col("__parts")).cast("int"), F.lit(0)))
    spread = low.select("__key", "least", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__place"))
    return dealt.join(spread, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__place"))).select(key, value, "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v) but the least of each component; component is that least node."""
    checkpoint_ready(edges.sparkSession)
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        most = 2 * state[0] if 2 * state[0] <= BROADCAST_PAIRS else both.groupBy("u").count().agg(F.max("count")).first()[0]
        large = with_least(both, "u", "v", 2 * state[0], most=most).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        joined = with_least(large, "u", "v", state[0], most=most)
        small = joined.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(joined.select("u", F.col("least").alias("v"))).distinct()
        now = small.checkpoint()
        before, state = state, mark(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
