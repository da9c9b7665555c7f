"""Removal of word windows that an earlier document already has, by a compressed full-text index for each shard.

A window is `WINDOW` consecutive words; a word goes if a window that covers it also begins in a document with a
smaller doc_id. Steps, over whole texts and all documents:

(1) Equal texts are one: a copy of a smaller doc_id's text loses all of its words if it has a window, and only the
least one goes on. (2) Each window has an anchor, the run of `GRAM` words in it with the least hash, so that equal
windows have equal anchors; an anchor stands for about 20 windows. Only windows whose anchor occurs in two texts or
more can repeat. (3) Those are cut in pieces, consecutive windows with one anchor, and the pieces go to the shard of
their anchor. (4) A shard indexes its pieces (`fm_index.FmIndex`: Burrows-Wheeler transform in a wavelet matrix) and
streams the documents' pieces through it by backward search; where the matching statistic reaches the window's
length, the least doc_id of the matching suffixes decides. Anchors of more than `HOT` pieces (a passage or line that
much text shares) would be one large group: their windows go one by one instead. Of these only windows whose core, the
words in whole tens around the anchor, occurs in two texts or more can repeat, so that those which lead from a shared
passage into a text's own words mostly stay at home. The rest are made one for each distinct window within a task and
again as they are shuffled, and are indexed in shards of their own; what comes back is the document that keeps each. (5) Documents with such windows are put together from what the shards found.

Defined results: a null text has no words; rows without doc_id keep all and make nothing repeat; rows that share a
doc_id are no earlier documents of each other; repeated rows are answered each. Texts shorter than a window keep all.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm._arrow import blanks, mix, ragged, release, slices, text_bytes
from tesserae.llm.fm_index import FmIndex
from tesserae.session import checkpoint_ready, table

WINDOW, GRAM = 50, 10
#: Windows in a piece at most, and pieces of an anchor beyond which its windows go one by one.
PIECE, HOT = 64, 512
#: Words that a task indexes at a time; an anchor's pieces, which stay together, are HOT * (PIECE + WINDOW) words at most.
BLOCK_WORDS = 200_000
#: Distinct hot windows that a task holds before it hands them on.
HELD = 65_536
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of texts: bytes, bounds of each word and of each text's words, and a 64-bit hash of each word."""

    def __init__(self, texts: pa.Array):
        self.flat, offsets = text_bytes(texts)
        solid = ~blanks(self.flat)
        first = np.zeros(len(self.flat) + 1, bool)
        first[offsets] = True
        before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        after = np.append(solid[1:], False) if len(solid) else solid
        self.starts = np.flatnonzero(solid & (~before | first[:-1]))
        self.ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.at = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.flat[solid]))]).dictionary_encode()
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
        self.hashes = hashed[found.indices.to_numpy()] if len(hashed) else hashed

    def joined(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the given words, one space between, end to end for runs of these counts, and the runs' bounds."""
        lengths = self.ends[words] - self.starts[words]
        spaced = np.append(self.flat, np.uint8(32))[ragged(self.starts[words], lengths + 1)]
        ends = np.cumsum(lengths + 1)
        spaced[ends - 1] = 32
        last = np.cumsum(counts)[counts > 0] - 1
        inner = np.ones(len(spaced), bool)
        inner[ends[last] - 1] = False
        sizes = np.zeros(len(counts), np.int64)
        sizes[counts > 0] = np.diff(np.concatenate([[0], ends[last]])) - 1
        return spaced[inner], np.concatenate([[0], np.cumsum(sizes)])

    def digests(self, kept: np.ndarray) -> list[str]:
        """SHA-256 of each text's kept words, joined by one space."""
        counts = np.add.reduceat(np.append(kept, False).astype(np.int64), self.at[:-1]) * (self.at[1:] > self.at[:-1]) if len(self.at) > 1 else np.zeros(0, np.int64)
        data, bounds = self.joined(np.flatnonzero(kept), counts)
        view = memoryview(np.ascontiguousarray(data))
        return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]


def grams_of(hashes: np.ndarray) -> np.ndarray:
    """The hash of each run of GRAM words of one text."""
    n = len(hashes) - GRAM + 1
    grams = hashes[:n].copy()
    for j in range(1, GRAM):
        grams = grams * _STEP + hashes[j : n + j]
    return mix(grams)


def anchors_of(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window of one text."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64)
    low, size, width = grams_of(hashes), 1, WINDOW - GRAM + 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def cores_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the core of the windows that start there, of one text.

    A window's words are counted off in tens from its anchor (the first, if it has the anchor twice), to both sides; the
    core is what the whole tens cover, 40 words or all 50. Equal windows have equal cores.
    """
    low, out = grams_of(hashes) if len(starts) else None, np.zeros(len(starts), np.int64)
    for lo in range(0, len(starts), 4096):
        some = starts[lo : lo + 4096]
        place = np.lib.stride_tricks.sliding_window_view(low, WINDOW - GRAM + 1)[some].argmin(axis=1)
        begin = place % GRAM
        core = (place // GRAM).astype(np.uint64)
        for j in range(WINDOW // GRAM):
            at = begin + GRAM * j
            inside = at + GRAM <= WINDOW
            core = np.where(inside, core * _STEP + low[some + np.where(inside, at, 0)], core)
        out[lo : lo + 4096] = mix(core).view(np.int64)
    return out


def pieces_of(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of windows with one anchor, each of PIECE windows at most."""
    begins = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(anchors)))
    parts = -(-sizes // PIECE)
    starts = np.repeat(begins, parts) + PIECE * ragged(np.zeros(len(parts), np.int64), parts)
    return starts, np.append(starts[1:], len(anchors))


def facts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, n_words, whole, anchors, pieces) of (doc_id, digest, text)."""
    for part in (s for b in batches for s in slices(b, 2)):
        words = Words(part.column(2))
        names, counts, sizes = [], [], []
        for a, b in zip(words.at[:-1], words.at[1:]):
            found = anchors_of(words.hashes[a:b])
            own, n = np.unique(found[pieces_of(found)[0]], return_counts=True)
            names.append(own)
            counts.append(n)
            sizes.append(len(own))
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).astype(np.int64))) for x in ([y.view(np.int64) for y in names], counts)]
        whole = words.digests(np.ones(len(words.starts), bool))
        yield pa.record_batch([part.column(0), part.column(1), pa.array(np.diff(words.at)), pa.array(whole), *lists], ["doc_id", "digest", "n_words", "whole", "anchors", "pieces"])


def listed_in(part: pa.RecordBatch, k: int, hot: bool) -> np.ndarray:
    """The anchors of row k of (digest, doc_id, text, anchors, hot) that are hot, or that are not."""
    return np.asarray(part.column(3)[k].as_py(), np.int64)[np.asarray(part.column(4)[k].as_py(), bool) == hot]


def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (anchor, digest, doc_id, start, text) of (digest, doc_id, text, anchors, hot)."""
    for part in (s for b in batches for s in slices(b, 2)):
        words, rows = Words(part.column(2)), []
        for k, (a, b) in enumerate(zip(words.at[:-1], words.at[1:])):
            found = anchors_of(words.hashes[a:b])
            starts, ends = pieces_of(found)
            use = np.isin(found[starts].view(np.int64), listed_in(part, k, False)) if len(starts) else np.zeros(0, bool)
            rows.append((np.full(use.sum(), k), starts[use], ends[use], found[starts[use]]))
        of, starts, ends, keys = map(np.concatenate, zip(*rows))
        for lo in range(0, len(of), 4096):
            o, s, e = of[lo : lo + 4096], starts[lo : lo + 4096], ends[lo : lo + 4096]
            sizes = e - s + WINDOW - 1
            data, bounds = words.joined(ragged(words.at[o] + s, sizes), sizes)
            texts = pa.Array.from_buffers(pa.string(), len(o), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.record_batch([pa.array(keys[lo : lo + 4096].view(np.int64)), part.column(0).take(pa.array(o)), part.column(1).take(pa.array(o)), pa.array(s.astype(np.int32)), texts], ["anchor", "digest", "doc_id", "start", "text"])


def hot_starts(words: Words, a: int, b: int, anchors: np.ndarray) -> np.ndarray:
    """Where the windows with one of these anchors start in the text whose words are a to b, counted from a."""
    return np.flatnonzero(np.isin(anchors_of(words.hashes[a:b]).view(np.int64), anchors))


def shared_starts(words: Words, a: int, b: int, anchors: np.ndarray, cores) -> np.ndarray:
    """Those of `hot_starts` whose core is one of these, as word places."""
    starts = hot_starts(words, a, b, anchors)
    return a + starts[np.isin(cores_of(words.hashes[a:b], starts), np.asarray(cores or (), np.int64))]


def hot_cores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, core) of the hot windows of (digest, doc_id, text, anchors, hot), each once for a text."""
    for part in (s for b in batches for s in slices(b, 2)):
        words, own = Words(part.column(2)), []
        for k, (a, b) in enumerate(zip(words.at[:-1], words.at[1:])):
            own.append(np.unique(cores_of(words.hashes[a:b], hot_starts(words, a, b, listed_in(part, k, True)))))
        of = np.repeat(np.arange(len(own)), [len(x) for x in own])
        yield pa.record_batch([part.column(0).take(pa.array(of)), pa.array(np.concatenate(own))], ["digest", "core"])


def hot_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) of each distinct hot window and the least document that has it, of (digest, doc_id, text, anchors, hot, cores).

    Windows are made one within the task before they leave it, about HELD at a time; a window may so come out again.
    """
    held: dict[bytes, tuple[int, str]] = {}

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array([d for d, _ in held.values()], pa.int64()), pa.array([t for _, t in held.values()], pa.string())], ["doc_id", "text"])

    for part in (s for b in batches for s in slices(b, 2)):
        words, ids = Words(part.column(2)), part.column(1).to_pylist()
        for k, (a, b) in enumerate(zip(words.at[:-1], words.at[1:])):
            starts = shared_starts(words, a, b, listed_in(part, k, True), part.column(5)[k].as_py())
            for lo in range(0, len(starts), HELD):
                some = starts[lo : lo + HELD]
                names = window_names(words, some)
                fresh = np.array([name not in held for name in names], bool)
                data, bounds = words.joined(ragged(some[fresh], np.full(fresh.sum(), WINDOW)), np.full(fresh.sum(), WINDOW))
                data, new = data.tobytes(), iter(zip(bounds[:-1], bounds[1:]))
                for name, is_fresh in zip(names, fresh):
                    if is_fresh:
                        x, y = next(new)
                        held.setdefault(name, (ids[k], data[x:y].decode()))
                    if ids[k] < held[name][0]:
                        held[name] = (ids[k], held[name][1])
                if len(held) >= HELD:
                    yield told()
                    held.clear()
    yield told()


def least_owners(words: Words, doc_ids: np.ndarray) -> np.ndarray:
    """For each word place of the pieces: the least doc_id whose pieces hold the window that begins there (none: the largest number)."""
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(words.hashes[a:b].tobytes(), len(seen)) for a, b in zip(words.at[:-1], words.at[1:])], np.int64)
    one = np.zeros(len(seen), np.int64)
    one[of[::-1]] = np.arange(len(of))[::-1]
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc_ids)
    lengths = np.diff(words.at)
    index = FmIndex(words.hashes[ragged(words.at[one], lengths[one])], lengths[one], WINDOW)
    classes = index.least_by_class(np.repeat(least, lengths[one] + 1))
    size, at = index.matches(words.hashes[ragged(words.at[one], lengths[one])], lengths[one])
    owner = np.full(len(size), np.iinfo(np.int64).max)
    whole = size == WINDOW
    owner[whole] = classes[index.classes(at[whole])]
    begin = np.concatenate([[0], np.cumsum(lengths[one])])
    return owner[ragged(begin[of], lengths)]


def blocks(batches: Iterable[pa.RecordBatch], key: int | None, text: int) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_WORDS words that never part rows of a key; rows come sorted by it."""
    held, size = [], 0
    for batch in (b for b in batches if b.num_rows):
        at = 0
        while at < batch.num_rows:
            lengths = np.cumsum(np.diff(text_bytes(batch.column(text).slice(at))[1])) // 6
            to = at + int(np.searchsorted(lengths, BLOCK_WORDS - size)) + 1
            if key is not None and to < batch.num_rows:
                keys = batch.column(key).to_numpy()
                to += int(np.argmax(np.append(keys[to:] != keys[to - 1], True)))
            part = batch.slice(at, min(to, batch.num_rows) - at)
            if held and size >= BLOCK_WORDS and (key is None or part.column(key)[0] != held[-1].column(key)[-1]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += int(lengths[part.num_rows - 1])
            at += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    release()


def repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, runs): runs of repeated windows (start, end, start, end, ...) of pieces sorted by anchor."""
    for block in blocks(batches, 0, 4):
        words, ids = Words(block.column(4)), block.column(2).to_numpy()
        owner, out = least_owners(words, ids), []
        for k, (a, b) in enumerate(zip(words.at[:-1], words.at[1:])):
            gone = np.concatenate([[False], owner[a : b - WINDOW + 1] < ids[k], [False]])
            turns = np.flatnonzero(gone[1:] != gone[:-1]) + block.column(3)[k].as_py()
            if len(turns):
                out.append((k, turns.tolist()))
        yield pa.record_batch([block.column(1).take(pa.array([k for k, _ in out], pa.int64())), pa.array([r for _, r in out], pa.list_(pa.int64()))], ["digest", "runs"])


def keepers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, window): the least document of each hot window (text, low); windows are told by a 128-bit hash."""
    for block in blocks(batches, None, 0):
        words = Words(block.column(0))
        owner = least_owners(words, block.column(1).to_numpy())[words.at[:-1]]
        yield pa.record_batch([pa.array(owner), pa.array(window_names(words, words.at[:-1]), pa.binary())], ["doc_id", "window"])


def window_names(words: Words, starts: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(words.hashes[a : a + WINDOW].tobytes()) for a in starts]


def assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept_sha256) of (digest, doc_id, text, anchors, hot, cores, runs, own windows)."""
    for part in (s for b in batches for s in slices(b, 2)):
        words = Words(part.column(2))
        change = np.zeros(len(words.starts) + 1, np.int64)
        for k, (a, b) in enumerate(zip(words.at[:-1], words.at[1:])):
            cores = part.column(5)[k].as_py()
            if cores:
                starts = shared_starts(words, a, b, listed_in(part, k, True), cores)
                own = set(part.column(7)[k].as_py() or ())
                gone = starts[[name not in own for name in window_names(words, starts)]] if len(starts) else starts
                np.add.at(change, gone, 1)
                np.add.at(change, gone + WINDOW, -1)
            runs = np.asarray([x for r in part.column(6)[k].as_py() or () for x in r], np.int64) + a
            np.add.at(change, runs[::2], 1)
            np.add.at(change, runs[1::2] + WINDOW - 1, -1)
        kept = np.cumsum(change[:-1]) == 0
        removed = np.diff(np.concatenate([[0], np.cumsum(~kept)])[words.at])
        yield pa.record_batch([part.column(1), pa.array(np.diff(words.at)), pa.array(removed), pa.array(words.digests(kept))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    checkpoint_ready(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    facts = texts.mapInArrow(facts_of, "doc_id long, digest binary, n_words long, whole string, anchors array<long>, pieces array<long>").checkpoint()
    listed = F.arrays_zip("anchors", "pieces")
    units = facts.filter(f"doc_id is not null and n_words >= {WINDOW}").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first(listed).alias("listed")).checkpoint()
    each = units.select("digest", "low", F.explode("listed").alias("x")).select("digest", "low", F.col("x.anchors").alias("anchor"), F.col("x.pieces").alias("pieces"))
    shared = each.groupBy("anchor").agg(F.count("digest").alias("n"), F.sum("pieces").alias("pieces")).filter("n > 1").select("anchor", (F.col("pieces") > HOT).alias("hot"))
    open_ = each.join(shared, "anchor").groupBy("digest", "low").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("hot").alias("hot")).checkpoint()

    asked = texts.join(open_, "digest").filter("doc_id = low").select("digest", "doc_id", "text", "anchors", "hot").checkpoint()
    pieces = asked.mapInArrow(cut, "anchor long, digest binary, doc_id long, start int, text string")
    runs = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(repeats, "digest binary, runs array<long>")
    hot = asked.filter(F.exists("hot", lambda x: x))
    cores = hot.mapInArrow(hot_cores, "digest binary, core long").checkpoint()
    common = cores.groupBy("core").agg(F.count("digest").alias("n")).filter("n > 1").select("core")
    told = cores.join(common, "core").groupBy("digest").agg(F.collect_list("core").alias("cores")).checkpoint()
    windows = hot.join(told, "digest").select("digest", "doc_id", "text", "anchors", "hot", "cores").mapInArrow(hot_windows, "doc_id long, text string").groupBy("text").agg(F.min("doc_id").alias("low"))
    own = windows.mapInArrow(keepers, "doc_id long, window binary").groupBy("doc_id").agg(F.collect_list("window").alias("own"))
    # what the shards say meets by digest first, so that the texts move once
    owned = own.join(open_.select("digest", F.col("low").alias("doc_id")), "doc_id").select("digest", "own")
    said = runs.groupBy("digest").agg(F.collect_list("runs").alias("runs")).join(owned, "digest", "full").join(told, "digest", "full")
    found = asked.join(said, "digest", "left")
    put = found.select("digest", "doc_id", "text", "anchors", "hot", "cores", "runs", "own").mapInArrow(assembled, "doc_id long, n_words long, n_removed long, kept_sha256 string")

    known = facts.join(units.select("digest", "low"), "digest", "left").join(open_.select("digest", F.lit(True).alias("open")), "digest", "left")
    copy = F.col("doc_id") > F.col("low")
    rest = known.filter(F.coalesce(copy, F.lit(False)) | F.col("open").isNull() | F.col("doc_id").isNull())
    settled = rest.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"))
    return put.unionByName(settled)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` without the windows that an earlier one has."""
    return remove_repeated(table(spark, sf_dir, "documents"))


SQL = r"""
WITH told AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
    SELECT doc_id, i, sha256(array_to_string(w[i + 1:i + 50], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM told WHERE len(w) >= 50)
), first_owner AS (
    SELECT k, min(doc_id) AS low FROM placed GROUP BY k HAVING count(*) > 1
), gone AS (
    SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM placed JOIN first_owner USING (k) WHERE doc_id > low) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[j + 1] FOR j IN list_sort(list_filter(range(len(w)), lambda x: NOT list_contains(js, x)))], ' ') END) AS kept_sha256
FROM told LEFT JOIN gone USING (doc_id)
"""
