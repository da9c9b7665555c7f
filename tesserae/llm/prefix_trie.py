"""The prefix trie of rebuilt conversations, with subtree sums by heavy-path decomposition.

A rebuilt conversation is the first h turns of its base conversation and its own turns after its first h. A node is a
distinct sequence of first turns; its key is the sum (two 64-bit lanes) of hashes of (place, role, text) over the
turns, which is a running sum over range-sorted rows, so that one conversation may be of any length.

Subtree sums. Each node's heavy child is the one with most members; nodes that heavy edges link are a path, found by
pointer doubling in as many rounds as the logarithm of the longest path. A light child has at most half of its
parent's members, so that the number of bits of a path's members falls from path to path towards the leaves: paths
are summed by that number, the smallest first, and each hands its total to the node it hangs from. There are at most
64 such rounds, over rows of paths alone. A last running sum along the paths, from their ends, gives each node its
own subtree. No conversation, path or member list is ever held in one place: the digest of a node's members streams
over chunks of sorted ids.

Defined results: turns are ordered by turn (null first), equal turns by role, then by their hash, repeated rows stay; a null role or text is
empty; rows without conv_id belong to no conversation. conv_id % 100 has the sign of conv_id, as in SQL. An empty
table has no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm._running import running, runs
from tesserae.session import checkpoint_ready, table

#: A conversation borrows up to BORROWED - 1 first turns from the first of its hundred.
BORROWED, HUNDRED = 6, 100
NO_MEMBER = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, size, t0, t1, chars) of every turn of the rebuilt conversations, and (conv_id, size) of them all."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = turns.filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t0"), F.xxhash64(F.lit(2), role, text).alias("t1"), F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one")
    )
    own = running(told, ["conv_id"], ["turn", "role", "t0", "t1"], {"nth": "one"}).select("conv_id", (F.col("nth") - 1).alias("at"), "t0", "t1", "chars").checkpoint()
    sizes = own.groupBy("conv_id").agg(F.count("at").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % BORROWED
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base")).join(bases, "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")).checkpoint()
    kept = own.join(convs, "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("place"), "size", "t0", "t1", "chars")
    heads = own.filter(F.col("at") < BORROWED - 1).withColumnRenamed("conv_id", "base")
    taken = convs.filter("lent > 0").join(heads, "base").filter("at < lent").select("conv_id", F.col("at").alias("place"), "size", "t0", "t1", "chars")
    return kept.unionByName(taken), convs.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with the key (k0, k1) of the prefix that ends in the turn, and that of the prefix before it (p0, p1)."""
    hashed = turns.withColumns({f"l{k}": F.xxhash64(F.lit(k + 1), "place", "t0", "t1") for k in (0, 1)}).drop("t0", "t1")
    return running(hashed, ["conv_id"], ["place"], {"k0": "l0", "k1": "l1"}, {"p0": "k0", "p1": "k1"}).drop("l0", "l1")


def trie(keyed: DataFrame, convs: DataFrame) -> DataFrame:
    """(k0, k1, p0, p1, depth, conv_id, n_convs, chars, n_children, parent_conv_id, heavy) of every node."""
    zero = F.lit(0).cast("long")
    inner = keyed.groupBy("k0", "k1").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"), (F.min("place") + 1).alias("depth"), F.min("conv_id").alias("conv_id"), F.count("place").alias("n_convs"), F.min("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs")).filter("n_convs > 0").select(zero.alias("k0"), zero.alias("k1"), zero.alias("p0"), zero.alias("p1"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"))
    nodes = inner.unionByName(root).checkpoint()
    largest = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("least"), "k0", "k1"))
    families = nodes.filter("depth > 0").groupBy("p0", "p1").agg(F.count("depth").alias("n_children"), largest.alias("child"))
    families = families.join(nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id")), ["p0", "p1"]).checkpoint()
    below = families.select(F.col("p0").alias("k0"), F.col("p1").alias("k1"), "n_children")
    above = families.select("p0", "p1", "parent_conv_id", F.col("child.k0").alias("h0"), F.col("child.k1").alias("h1"))
    out = nodes.join(below, ["k0", "k1"], "left").join(above, ["p0", "p1"], "left")
    is_root = F.col("depth") == 0
    return out.select(
        "k0", "k1", "p0", "p1", "depth", "conv_id", "n_convs", "chars", F.coalesce("n_children", zero).alias("n_children"), F.when(~is_root, F.col("parent_conv_id")).alias("parent_conv_id"),
        (~is_root & (F.col("h0") == F.col("k0")) & (F.col("h1") == F.col("k1"))).alias("heavy"),
    ).checkpoint()


def tops(nodes: DataFrame) -> DataFrame:
    """(k0, k1, u0, u1): the top node of each node's path, by pointer doubling.

    Nodes that have not reached their top point to different nodes, each the same number of heavy edges above, so
    that no round has a hot key.
    """
    state = nodes.select("k0", "k1", *[F.when(F.col("heavy"), F.col(f"p{k}")).otherwise(F.col(f"k{k}")).alias(f"u{k}") for k in (0, 1)], (~F.col("heavy")).alias("done")).checkpoint()
    while state.filter("not done").limit(1).count():
        ahead = state.select(F.col("k0").alias("u0"), F.col("k1").alias("u1"), F.col("u0").alias("v0"), F.col("u1").alias("v1"), F.col("done").alias("there"))
        moved = state.filter("not done").join(ahead, ["u0", "u1"]).select("k0", "k1", F.col("v0").alias("u0"), F.col("v1").alias("u1"), F.col("there").alias("done"))
        state = state.filter("done").unionByName(moved).checkpoint()
    return state.drop("done")


def subtree_sums(nodes: DataFrame, own: dict) -> DataFrame:
    """nodes with the sum of each of own (name: expression) over the subtree of each node."""
    names = list(own)
    placed = nodes.join(tops(nodes), ["k0", "k1"]).select("*", *[v.cast("long").alias(f"own_{c}") for c, v in own.items()]).checkpoint()
    along = placed.groupBy("u0", "u1").agg(*[F.sum(f"own_{c}").alias(c) for c in names])
    heads = placed.filter("not heavy").select(F.col("k0").alias("u0"), F.col("k1").alias("u1"), "p0", "p1", "depth", F.length(F.bin("n_convs")).alias("bits"))
    holders = placed.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("u0").alias("w0"), F.col("u1").alias("w1"))
    paths = heads.filter("depth > 0").join(along, ["u0", "u1"]).join(holders, ["p0", "p1"]).checkpoint()
    done: list[DataFrame] = []
    for bits in sorted(r[0] for r in paths.select("bits").distinct().collect()):
        ready = paths.filter(F.col("bits") == bits)
        if done:
            hung = union(done).groupBy(F.col("w0").alias("u0"), F.col("w1").alias("u1")).agg(*[F.sum(c).alias(f"more_{c}") for c in names])
            ready = ready.join(hung, ["u0", "u1"], "left").select("p0", "p1", "w0", "w1", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("long"))).alias(c) for c in names])
        done.append(ready.groupBy("p0", "p1", "w0", "w1").agg(*[F.sum(c).alias(c) for c in names]).checkpoint())
    if done:
        hung = union(done).groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(*[F.sum(c).alias(f"more_{c}") for c in names])
        placed = placed.join(hung, ["k0", "k1"], "left").select(*placed.columns, *[F.coalesce(f"more_{c}", F.lit(0).cast("long")).alias(f"more_{c}") for c in names])
    worth = placed.withColumns({f"own_{c}": F.col(f"own_{c}") + (F.col(f"more_{c}") if done else 0) for c in names})
    return running(worth, ["u0", "u1"], [F.col("depth").desc()], {c: f"own_{c}" for c in names}).select(*nodes.columns, *names)


def union(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def member_digests(members: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256): SHA-256 of each key's conv_ids, ascending and joined by commas.

    Ids are sorted over all tasks and joined in chunks, at most one for each batch and key; a key's chunks then stream
    through one digest, which is sequential by nature, in constant memory.
    """

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            ids, begins = batch.column(2).to_numpy(), runs(batch, [0, 1], None)[0]
            starts = np.concatenate([[0], begins])
            texts = [",".join(map(str, x.tolist())) for x in np.split(ids, begins)]
            yield pa.record_batch([batch.column(0).take(pa.array(starts)), batch.column(1).take(pa.array(starts)), pa.array(ids[starts]), pa.array(texts)], ["k0", "k1", "first", "chunk"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for k0, k1, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if key == (k0, k1):
                    digest.update(b"," + chunk.encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k0, k1), hashlib.sha256(chunk.encode())
            if len(out) > 10_000:
                yield told(out)
                out = []
        yield told(out + ([(*key, digest.hexdigest())] if key else []))

    def told(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["k0", "k1", "ends_sha256"])

    ordered = members.select("k0", "k1", "conv_id").repartitionByRange("k0", "k1", "conv_id").sortWithinPartitions("k0", "k1", "conv_id")
    joined = ordered.mapInArrow(chunks, "k0 long, k1 long, first long, chunk string")
    return joined.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "first").mapInArrow(digests, "k0 long, k1 long, ends_sha256 string")


def nodes_of(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations, with counts of members, children, leaves and saved tokens."""
    checkpoint_ready(conversations.sparkSession)
    turns, convs = rebuilt(conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text"))
    keyed = prefixes(turns).checkpoint()
    tree = subtree_sums(trie(keyed, convs), {"n_leaves": F.col("n_children") == 0, "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    zero = F.lit(0).cast("long")
    members = keyed.filter("place + 1 = size").select("k0", "k1", "conv_id").unionByName(convs.filter("size = 0").select(zero.alias("k0"), zero.alias("k1"), "conv_id"))
    out = tree.join(member_digests(members), ["k0", "k1"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBER)).alias("ends_sha256"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt `conversations`."""
    return nodes_of(table(spark, sf_dir, "conversations"))


SQL = """
WITH crc AS (
    SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
        list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), told AS (
    SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
    SELECT o.conv_id, coalesce(b.turns[:h], []) || o.turns[h + 1:] AS turns FROM told o JOIN crc USING (conv_id) LEFT JOIN told b ON b.conv_id = o.conv_id - o.conv_id % 100
), steps AS (
    SELECT conv_id, len(turns) AS size, d AS depth, turns[:d]::VARCHAR || d AS k, turns[:d - 1]::VARCHAR || (d - 1) AS p, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars
    FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), nodes AS (
    SELECT k, any_value(p) AS p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
           sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM steps GROUP BY k
), counted AS (
    SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.p = n.k AND c.depth > 0) AS n_children FROM nodes n
), above AS (
    SELECT DISTINCT a.k AS top, n.k, n.n_children, (n.n_convs - 1) * n.chars AS saved FROM counted n JOIN steps s ON s.k = n.k JOIN steps a ON a.conv_id = s.conv_id AND a.depth <= s.depth
), sums AS (
    SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY top
)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN q.conv_id END AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN sums ON sums.top = n.k LEFT JOIN nodes q ON q.k = n.p
"""
