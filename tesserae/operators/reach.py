"""How much each node reaches, and what of it, without a row for each pair.

Targets are dealt to blocks of bits. Within a block, every component of the graph holds one row of bits, and a pass
from the leaves up ORs the rows of what a component needs into its own; the ones are counted and the blocks' counts
added. Time goes by edges times blocks, so that BLOCK targets cost one walk over the graph. Graphs of up to LOCAL_EDGES
edges (counted first) travel to the tasks as arrays, and tasks take blocks; longer edge lists carry words of 64 targets
along edges by joins, where a row holds a word and only bits that are new are sent on. Counts can carry the bits of the
starts the other way instead and sum the words by column; the way that fills its words better is taken.

A node is not in its own reach, even on a cycle. Edges and targets with a null end are left out; repeated ones count
once; starts or targets without edges are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import LOCAL_EDGES, SENT_ROWS, fits, gathered, local_components, local_edges, plain, reverse, sent, spread, wide
from tesserae.operators.relational import numbered
from tesserae.session import checkpoint_ready

#: Targets in a block: bits of a component's row.
BLOCK = 1024
#: Most blocks of 64 starts whose names are sent to every task.
SENT_BLOCKS = 256
#: Rounds whose words are held against new ones before those that can still get bits are put together.
TOGETHER = 4
#: A round that no loop gets to.
EVER = 2**31 - 1


@dataclass
class Levels:
    """A graph's components, numbered, and for each level above the leaves its components, all that these need, and where each one's needs begin."""

    nodes: list
    of: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    size: int

    def reached(self, targets: np.ndarray) -> np.ndarray:
        """Rows of bits by component: which of the targets (components, repeated for several nodes of one) it reaches or holds."""
        words = -(-len(targets) // 64)
        rows = np.zeros((self.size, words), np.uint64)
        places = np.arange(len(targets))
        np.bitwise_or.at(rows, (targets, places >> 6), np.uint64(1) << (places & 63).astype(np.uint64))
        for own, needs, begins in self.levels:
            rows[own] |= np.bitwise_or.reduceat(rows[needs], begins, axis=0)
        return rows


def levels_of(adjacency: dict, extra: list) -> Levels:
    """The condensed graph in levels, leaves first."""
    found = local_components(adjacency, set(adjacency) | set(extra))
    place = {c: k for k, c in enumerate(dict.fromkeys(found.values()))}
    nodes = sorted(found)
    needs: dict[int, set] = {}
    for s, ds in adjacency.items():
        a = place[found[s]]
        needs.setdefault(a, set()).update(place[found[d]] for d in ds)
    level = np.zeros(len(place), np.int64)
    for c in reversed(range(len(place))):  # components come before what they need
        level[c] = 1 + max((level[d] for d in needs.get(c, ()) if d != c), default=-1)
    levels = []
    order = np.argsort(level, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(level[order])) + 1)[1:] if len(order) else []:
        lists = [sorted(needs[c] - {c}) for c in own.tolist()]
        sizes = np.array([len(x) for x in lists])
        levels.append((own, np.concatenate([np.array(x, np.int64) for x in lists]), np.cumsum(sizes) - sizes))
    return Levels(nodes, np.array([place[found[n]] for n in nodes], np.int64), levels, len(place))


def local_graph(edges: DataFrame, ids: DataFrame, limit: int) -> Levels | None:
    """None if there are more edges or ids than the limit."""
    adjacency = local_edges(edges, limit)
    if adjacency is None:
        return None
    return levels_of(adjacency, ids.toArrow().column(0).to_pylist()) if fits(ids, limit) else None


def ids_of(df: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node): the frame's ids, or every node with an edge."""
    if df is None:
        return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return df.select(F.col(df.columns[0]).alias("node")).filter("node IS NOT NULL").distinct()


def target_places(graph: Levels, targets: DataFrame) -> np.ndarray:
    """Places of the targets among the graph's nodes."""
    place = {n: k for k, n in enumerate(graph.nodes)}
    return np.array(sorted(place[n] for n in targets.toArrow().column(0).to_pylist()), np.int64)


def blocks_of(edges: DataFrame, n_targets: int) -> DataFrame:
    blocks = -(-n_targets // BLOCK)
    return edges.sparkSession.range(0, blocks, 1, max(1, min(blocks, edges.sparkSession.sparkContext.defaultParallelism * 4)))


def reach_counts(edges: DataFrame, starts: DataFrame | None = None, targets: DataFrame | None = None, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(node, n) for each start (default: every node with an edge): how many targets (default: such nodes) it reaches."""
    edges = plain(edges)
    starts, targets = ids_of(starts, edges), ids_of(targets, edges)
    graph = local_graph(edges, starts.unionByName(targets).distinct(), local_limit)
    if graph is None:
        return counts_by_joins(edges, starts, targets)
    places = target_places(graph, targets)
    at = graph.of[places]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(graph.size, np.int64)
        for block in (b for batch in batches for b in batch.column(0).to_pylist()):
            total += np.bitwise_count(graph.reached(at[block * BLOCK : (block + 1) * BLOCK])).sum(1, dtype=np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["c", "all"])

    totals = blocks_of(edges, len(at)).mapInArrow(counted, "c long, all long").groupBy("c").agg(F.sum("all").alias("all"))
    own = np.zeros(len(graph.nodes), np.int64)
    own[places] = 1
    known = members(edges, graph, own).join(starts.withColumnRenamed("node", "s"), F.col("node") == F.col("s"), "left_semi")
    return known.join(totals.withColumnRenamed("c", "__c"), F.col("component") == F.col("__c"), "left").select("node", (F.coalesce("all", F.lit(0)) - F.col("own")).cast("long").alias("n"))


def counts_by_joins(edges: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """The same for graphs of any size. Bits are those of the ends, starts or targets, that make fewer words in the first step."""
    begun, ended = marked(starts), marked(targets)
    own = targets.select(F.col("node").alias("t"))
    if first_words(reverse(edges), begun) < first_words(edges, ended):
        words = words_by_joins(reverse(edges), begun).join(wide(own), F.col("node") == F.col("t"), "left_semi")
        columns = words.groupBy("block").agg(*[F.sum(F.getbit("word", F.lit(k)).cast("long")).alias(f"b{k}") for k in range(64)])
        sums = columns.select(F.col("block").alias("b"), F.posexplode(F.array(*[f"b{k}" for k in range(64)])).alias("k", "all"))
        rows = begun.join(wide(sums), (F.col("block") == F.col("b")) & (F.col("bit") == F.col("k")), "left")
    else:
        words = words_by_joins(edges, ended).groupBy("node").agg(F.sum(F.bit_count("word")).cast("long").alias("all"))
        rows = starts.join(wide(words.withColumnRenamed("node", "w")), F.col("node") == F.col("w"), "left")
    rows = rows.join(wide(own), F.col("node") == F.col("t"), "left")
    return rows.select("node", (F.coalesce("all", F.lit(0)) - F.when(F.col("t").isNotNull(), 1).otherwise(0)).cast("long").alias("n"))


def marked(ids: DataFrame) -> DataFrame:
    """(node, block, bit): the ids in order, 64 to a block."""
    return numbered(ids, [F.col("node")], "place", 0).select("node", F.expr("place div 64").alias("block"), F.expr("CAST(place % 64 AS INT)").alias("bit"))


def first_words(edges: DataFrame, marks: DataFrame) -> int:
    """About how many words the first step makes when the marks of what edges lead to are carried against them."""
    known = marks.select(F.col("node").alias("m"), "block")
    return edges.join(wide(known), F.col("dst") == F.col("m")).agg(F.approx_count_distinct(F.xxhash64("src", "block"))).first()[0]


def members(edges: DataFrame, graph: Levels, own: np.ndarray) -> DataFrame:
    kind = pa.array(graph.nodes) if graph.nodes else pa.array([], pa.int64())
    made = edges.sparkSession.createDataFrame(pa.table({"node": kind, "component": pa.array(graph.of), "own": pa.array(own)}))
    return made.withColumn("node", F.col("node").cast(edges.schema["src"].dataType))


def reach_lists(edges: DataFrame, targets: DataFrame, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(node, reached) for each node with an edge that reaches targets: these, sorted, itself not among them."""
    edges = plain(edges)
    targets = ids_of(targets, edges)
    graph = local_graph(edges, targets, local_limit)
    if graph is None:
        marks = marked(targets)
        tables = marks.withColumnRenamed("node", "target").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "target"))).alias("names"))
        rows = words_by_joins(edges, marks).join(wide(tables), "block")
        bits = F.transform(F.filter("names", lambda x: F.getbit(F.col("word"), x["bit"]) == 1), lambda x: x["target"])
        lists = rows.select("node", "block", bits.alias("some"))
    else:
        places = target_places(graph, targets)
        at, names = graph.of[places], [graph.nodes[k] for k in places]
        kind = edges.schema["src"].dataType.simpleString()

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in (b for batch in batches for b in batch.column(0).to_pylist()):
                rows = graph.reached(at[block * BLOCK : (block + 1) * BLOCK])
                some = np.flatnonzero(rows.any(1))
                for part in np.array_split(some, max(1, len(some) // 4096)):
                    bits = np.unpackbits(np.ascontiguousarray(rows[part]).view(np.uint8), axis=1, bitorder="little")
                    found = [[names[block * BLOCK + k] for k in np.flatnonzero(r)] for r in bits]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([block] * len(part), pa.int64()), pa.array(found)], ["c", "block", "some"])

        lists = blocks_of(edges, len(at)).mapInArrow(listed, f"c long, block long, some array<{kind}>")
        lists = members(edges, graph, np.zeros(len(graph.nodes), np.int64)).join(lists, F.col("component") == F.col("c")).select("node", "block", "some")
    whole = lists.groupBy("node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "some"))), lambda x: x["some"])).alias("reached"))
    return whole.select("node", F.array_remove("reached", F.col("node")).alias("reached")).filter("size(reached) > 0")


def last_rounds(steps: DataFrame) -> DataFrame:
    """(node, until): the last round in which anything can come to a node along steps (mid, to); EVER if that wasn't looked for.

    Steps from nodes that nothing comes to any more go, round by round, as long as a quarter of them goes; on cycles none do.
    """
    left, n, parts, now = steps, steps.count(), [], 1
    while True:
        ends = left.select(F.col("to").alias("node")).distinct().checkpoint()
        parts.append(ends.withColumn("until", F.lit(now)))
        left = left.join(wide(ends.select(F.col("node").alias("e"))), F.col("mid") == F.col("e"), "left_semi").checkpoint()
        before, n, now = n, left.count(), now + 1
        if 4 * n > 3 * before or n <= SENT_ROWS:
            parts.append(left.select(F.col("to").alias("node")).distinct().withColumn("until", F.lit(EVER)))
            return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.max("until").alias("until"))


def words_by_joins(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, block, word): for each node and 64 of the marked, bits of those that it reaches or is, in one row."""
    return bits_by_joins(edges, marks).groupBy("node", "block").agg(F.bit_or("word").alias("word"))


def bits_by_joins(edges: DataFrame, marks: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, block, word): for each node and 64 of the marked, bits of those that it reaches, by `depth` edges at most, or is.

    A bit is in one row, but a node's word of a block can be in several. Only new bits travel, along edges that can still
    carry some, and are held against the words of nodes that can still get some.
    """
    checkpoint_ready(edges.sparkSession)
    steps = edges.select(F.col("dst").alias("mid"), F.col("src").alias("to")).checkpoint()
    until = last_rounds(steps).checkpoint()
    ends = [until.select(F.col("node").alias(f"e{k}"), F.col("until").alias(f"u{k}")) for k in range(3)]
    steps = steps.join(wide(ends[0]), F.col("mid") == F.col("e0"), "left").join(wide(ends[1]), F.col("to") == F.col("e1"))
    steps = steps.select("mid", "to", F.coalesce("u0", F.lit(0)).alias("carries"), F.col("u1").alias("until")).checkpoint()
    new = marks.join(wide(ends[2]), F.col("node") == F.col("e2"), "left").select("node", "block", F.expr("shiftleft(1L, bit)").alias("word"), F.coalesce("u2", F.lit(0)).alias("until")).checkpoint()
    parts, live, now = [new], [new], 1
    while not new.isEmpty() and (depth is None or now <= depth):
        ways = steps.filter(F.col("carries") >= now - 1)
        come = ways.join(sent(new.drop("until")), F.col("node") == F.col("mid")).groupBy(F.col("to").alias("node"), "block").agg(F.bit_or("word").alias("sent"), F.max("until").alias("until"))
        held = reduce(DataFrame.unionByName, live).filter(F.col("until") >= now)
        if len(live) > TOGETHER:
            held = held.checkpoint()
            live = [held]
        known = held.groupBy(F.col("node").alias("k"), F.col("block").alias("b")).agg(F.bit_or("word").alias("old"))
        fresh = come.join(wide(known), (F.col("node") == F.col("k")) & (F.col("block") == F.col("b")), "left").select("node", "block", F.expr("sent & ~coalesce(old, 0L)").alias("word"), "until")
        new = fresh.filter("word != 0").checkpoint()
        parts.append(new)
        live.append(new)
        now += 1
    return gathered(parts).select("node", "block", "word")


def pairs_by_joins(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst) for every other dst that a start (node) reaches within `depth` steps: words of 64 starts travel, pairs are made at the end and never shuffled."""
    checkpoint_ready(edges.sparkSession)
    marks = marked(starts).checkpoint()
    names = marks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", F.col("node").alias("src")))).alias("names"))
    words = bits_by_joins(reverse(edges), marks, depth)
    rows = words.join(F.broadcast(names) if fits(names, SENT_BLOCKS) else wide(names), "block")
    bits = F.filter("names", lambda x: F.getbit(F.col("word"), x["bit"]) == 1)
    return rows.select(F.explode(bits).alias("x"), F.col("node").alias("dst")).select("x.src", "dst").filter("src != dst")


def carried(edges: DataFrame, state: DataFrame, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(node, label): the least label of state (node, label) that reaches each node along edges; a node has its own.

    Within the bound one walk for all: labels are taken from the least, and a node that has one is not entered again.
    """
    state = state.select("node", "label").filter("node IS NOT NULL AND label IS NOT NULL")
    adjacency = local_edges(plain(edges), local_limit)
    if adjacency is None or not fits(state, local_limit):
        return spread(plain(edges), state, ["label"], [])
    rows, label = state.toArrow(), {}
    for x, node in sorted(zip(rows["label"].to_pylist(), rows["node"].to_pylist())):
        if node not in label:
            label[node], todo = x, [node]
            while todo:
                for n in adjacency.get(todo.pop(), ()):
                    if n not in label:
                        label[n] = x
                        todo.append(n)
    kinds = [state.schema[c].dataType.simpleString() for c in ("node", "label")]
    return state.sparkSession.createDataFrame(sorted(label.items()), f"node {kinds[0]}, label {kinds[1]}")
