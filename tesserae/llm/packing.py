"""Best-fit packing with swap-based local search.

Texts become token lists, lists longer than `CAPACITY` are cut, and only the lengths go on: pieces are dealt into
shards of about `SHARD_DOCS` documents by a hash, and each shard is packed on its own. Within a shard, best fit
in falling order of length comes first; then, while there are more bins than the total length asks for, pairs of
underfull bins make moves and one-for-one and two-for-one exchanges, the emptiest bins first. Each exchange
moves a positive amount from the emptier to the fuller bin and so increases the sum of squared fills, until bins
are empty and go, or no exchange is left that increases the sum. Then the underfull bins of all shards are brought
together, dealt anew, and searched again in the same way (`gather`).

Shards bound memory whatever the input's size. Where all that is underfull fits in one group, the last search is
over all of it; beyond that, rounds go on until two running save no sequence.

Defined results: a null or empty text is the end id alone, one piece of length 1; repeated rows are packed as
often as they occur; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import _arrow
from tesserae.session import checkpoint_ready, table

CAPACITY, END_ID, SHARD_DOCS = 4096, 1, 16384
#: Most words whose ids a worker holds, and most bytes of these that it keeps from one task to the next.
MEMO_WORDS, KEPT_CHARS = 800_000, 16_000_000
#: Bytes of text that are encoded at a time: what a worker needs for these comes on top of the words that it holds.
SLICE_BYTES = 2_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts; white space only parts words and case is dropped, so equal lower-case words are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo = _arrow.Memo(self._ids, MEMO_WORDS)

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def rest(self) -> None:
        """At a task's end: words stay for the worker's next task, unless they are too long to hold."""
        if self.memo.place is not None and self.memo.place.nbytes > KEPT_CHARS:
            self.memo.clear()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets = _arrow.text_bytes(texts)
        chunks, at = _arrow.cut(flat, offsets, _arrow.blanks(flat) | _arrow.before_punctuation(flat))
        words = pc.ascii_lower(pc.ascii_trim_whitespace(chunks.view(pa.string())))
        ids, ends = self.memo.get(words)
        return ids, ends[at]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of every piece; salt numbers rows of equal doc_id and text in a task.

    Equal rows can change places, so a task that runs again on the same rows in another order yields the same pieces.
    """
    path = path or vocabulary_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, met = word_encoder(path), Counter()
        for batch in batches:
            for part in _arrow.slices(batch, 1, SLICE_BYTES):
                ids, ends = tool.encode(part.column(1))
                # every text's ids with the end id behind them
                n, shift = len(ends) - 1, np.arange(len(ends))
                whole = np.full(len(ids) + n, END_ID, "<u4")
                keep = np.ones(len(whole), bool)
                keep[ends[1:] + shift[:-1]] = False
                whole[keep] = ids
                bounds = ends + shift
                lengths = np.diff(bounds)
                counts = -(-lengths // capacity)
                owner = np.repeat(np.arange(n), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                size = np.minimum(lengths[owner] - start, capacity)
                at = bounds[owner] + start
                raw = memoryview(whole.tobytes())
                salt = np.zeros(n, np.int64)
                for i, name in enumerate(part.column(0).to_pylist()):
                    row = xxhash.xxh3_64_intdigest(raw[4 * bounds[i] : 4 * bounds[i + 1]], xxhash.xxh3_64_intdigest(repr(name)))
                    salt[i] = met[row]
                    met[row] += 1
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt[owner], pa.int64())], names
                )
        tool.rest()
        _arrow.release()

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items in falling order of length, each into the fullest bin that takes it.

    `free` has a bit for every room that some bin has left, so the least sufficient room is one shift away.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    free = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        rooms[room].append(b)
        if room:
            free |= 1 << room
    return bins


class Bin:
    """Items in rising order of length."""

    def __init__(self, items: list[int], lengths: list[int], capacity: int):
        self.items = sorted(items, key=lengths.__getitem__)
        self.sizes = [lengths[i] for i in self.items]
        self.room = capacity - sum(self.sizes)

    def take(self, k: int) -> tuple[int, int]:
        size = self.sizes.pop(k)
        self.room += size
        return self.items.pop(k), size

    def put(self, item: int, size: int) -> None:
        k = bisect_left(self.sizes, size)
        self.sizes.insert(k, size)
        self.items.insert(k, item)
        self.room -= size

    def pair(self, low: int, high: int) -> tuple[int, int] | None:
        """Two items with the least sum from low to high."""
        i, j, best = 0, len(self.sizes) - 1, None
        while i < j:
            s = self.sizes[i] + self.sizes[j]
            if s < low:
                i += 1
            else:
                if s <= high and (best is None or s < best[0]):
                    best = (s, i, j)
                j -= 1
        return best and best[1:]


def exchange(low: Bin, high: Bin) -> bool:
    """Move as much as one exchange can from `low` to `high`, which takes at most its room; whether any was found."""
    room, best = high.room, (0, (), ())
    for a, size in enumerate(low.sizes):  # a move, or one of low for one or two of high
        if best[0] == room:
            break
        if size <= room:
            if size > best[0]:
                best = (size, (a,), ())
            continue
        b = bisect_left(high.sizes, size - room)
        if b < len(high.sizes) and high.sizes[b] < size - best[0]:
            best = (size - high.sizes[b], (a,), (b,))
        if (two := high.pair(size - room, size - best[0] - 1)) is not None:
            best = (size - high.sizes[two[0]] - high.sizes[two[1]], (a,), two)
    for b, size in enumerate(high.sizes):  # two of low for one of high
        if best[0] == room:
            break
        i, j = 0, len(low.sizes) - 1
        while i < j:
            gain = low.sizes[i] + low.sizes[j] - size
            if gain > room:
                j -= 1
            else:
                if gain > best[0]:
                    best = (gain, (i, j), (b,))
                i += 1
    if not best[0]:
        return False
    out = [low.take(k) for k in sorted(best[1], reverse=True)]
    back = [high.take(k) for k in sorted(best[2], reverse=True)]
    for x in out:
        high.put(*x)
    for x in back:
        low.put(*x)
    return True


def gains(bin_: Bin, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """What the bin gains from one item of a size, for one or two or none of its own, and from two of a sum, for one."""
    size = np.arange(capacity + 1)
    own = np.unique(np.array(bin_.sizes, np.int64))

    def best(back: np.ndarray) -> np.ndarray:
        """size - the least of `back` from size - room to size - 1."""
        least = np.searchsorted(back, np.maximum(size - bin_.room, 0))
        least = np.append(back, capacity + 1)[least]
        return np.where(least < size, size - least, 0).astype(np.int16)

    return best(np.unique(np.concatenate([[0], own, sums_of_two(bin_)]))), best(own)


def sums_of_two(bin_: Bin) -> np.ndarray:
    """Distinct sums of two items; a bin has few distinct sizes, since they add up to at most the capacity."""
    own, n = np.unique(np.array(bin_.sizes, np.int64), return_counts=True)
    i, j = np.triu_indices(len(own), 1)
    return np.unique(np.concatenate([own[i] + own[j], 2 * own[n > 1]]))


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange between pairs of underfull bins, from the emptier to the fuller, while a bin could be saved.

    Passes over the underfull bins, the emptiest first, go on until the bins are as few as the total length asks for
    or a pass finds nothing. A table of what each bin would gain from each size (`gains`) tells at once which pairs
    have an exchange, so that none is left out and none is tried in vain; the largest gain comes first.
    """
    least = -(-sum(lengths) // capacity)
    made = [Bin(b, lengths, capacity) for b in bins]
    if len(made) <= least:
        return [b.items for b in made]
    under = [b for b in made if b.room]
    one, two = (np.zeros((capacity + 1, len(under)), np.int16) for _ in range(2))
    rooms = np.array([b.room for b in under], np.int64)
    for k, b in enumerate(under):
        one[:, k], two[:, k] = gains(b, capacity)
    left, moved = len(made), True
    while moved and left > least:
        moved = False
        for k in np.argsort(-rooms, kind="stable").tolist():
            low = under[k]
            while low.items and left > least:
                gain = one[np.unique(np.array(low.sizes, np.int64))].max(axis=0)
                sums = sums_of_two(low)
                if len(sums):
                    gain = np.maximum(gain, two[sums].max(axis=0))
                gain[(rooms > low.room) | (rooms == capacity)] = 0
                gain[k] = 0
                to = int(gain.argmax())
                if not gain[to] or not exchange(low, under[to]):
                    break
                moved = True
                for at in (k, to):
                    rooms[at] = under[at].room
                    one[:, at], two[:, at] = gains(under[at], capacity)
            left = sum(1 for b in made if b.items) if not low.items else left
            if left <= least:
                break
    return [b.items for b in made if b.items]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def gather(packed: DataFrame, capacity: int, shard_docs: int) -> DataFrame:
    """The sequences of all shards, after further searches that bring underfull ones together.

    What is underfull is dealt anew into groups of about `shard_docs` pieces, whole sequences at a time: by fill, the
    emptiest together, and by a hash, in turn. It ends when one group held all of it, or two rounds running saved none.
    """
    spark, schema = packed.sparkSession, packed.schema
    checkpoint_ready(spark)
    names, done, round_, groups, idle = packed.columns, None, 0, 0, 0

    def run(group: pa.Table) -> pa.Table:
        order = group.select(names).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        lengths, ids = order["length"].to_pylist(), order["sequence_id"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist()
        bins = [list(range(a, b)) for a, b in zip(starts, [*starts[1:], len(ids)])]
        return placed(order, local_search(bins, lengths, capacity), lengths, ids[starts])

    while True:
        packed = packed.checkpoint()
        open_ = packed.filter(F.col("fill") < capacity)
        size = open_.agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("offset") == 0).alias("bins"), F.sum("length").alias("total")).first()
        # sequences beyond what their total length asks for; filling one up changes nothing here, emptying one does
        excess = size["bins"] - -(-(size["total"] or 0) // capacity)
        idle = idle + 1 if round_ and excess >= before else 0
        if excess <= 0 or groups == 1 or idle == 2:
            return (packed if done is None else done.unionByName(packed)).drop("fill")
        closed = packed.filter(F.col("fill") >= capacity)
        done = closed if done is None else done.unionByName(closed)
        groups, round_, before = -(-size["pieces"] // shard_docs), round_ + 1, excess
        code = F.xxhash64("sequence_id", F.lit(round_))
        if round_ % 2:
            rows, total = [], 0
            for r in sorted(open_.groupBy("fill").count().collect()):
                rows.append((r[0], total // shard_docs, -(-r[1] // shard_docs)))
                total += r[1]
            at = F.broadcast(spark.createDataFrame(rows, "__fill long, first long, parts long"))
            dealt = open_.join(at, F.col("fill") == F.col("__fill")).withColumn("group", F.col("first") + F.pmod(code, F.col("parts")))
        else:
            dealt = open_.withColumn("group", F.pmod(code, F.lit(groups)))
        packed = dealt.groupBy("group").applyInArrow(run, schema)


def placed(order: pa.Table, bins: list[list[int]], lengths: list[int], ids: np.ndarray) -> pa.Table:
    """The pieces with their sequence, their offset and their sequence's fill."""
    sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, items in enumerate(bins):
        at = 0
        for i in items:
            sequence[i], offset[i] = ids[k], at
            at += lengths[i]
        fill[items] = at
    kept = order.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    shards = max(1, -(-df.count() // shard_docs))
    pieces = pieces_of(df, doc_id, text, capacity, path)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(shards)))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        lengths = order["length"].to_pylist()
        base = order["shard"][0].as_py() << 32
        bins = pack(lengths, capacity)
        return placed(order, bins, lengths, base + np.arange(len(bins)))

    packed = pieces.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long")
    return gather(packed, capacity, shard_docs)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
