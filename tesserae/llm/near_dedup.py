"""Near-duplicate classes: fast similarity sketches, banding, and exact verification.

A document's set is its distinct shingles of five words (lower case A-Z, 64-bit hashes). Two documents are
linked if their sets' Jaccard similarity reaches a given per cent (`PERCENT` by default); classes are the connected components.

Sketch. `T` bins are filled in rounds: in each of the first T rounds every shingle is hashed anew to one bin, and
bins that are still open take the least hash of those that fall in; rounds T to 2T - 1 offer every shingle to one
bin each, so no bin can stay open. Two sets agree in a bin with a probability of their similarity, and agreements
concentrate as for independent samples. T = BANDS * ROWS bins make BANDS keys. Both follow from the per cent asked
for (`Plan`): 48 bands of 8 for 85, 51 of 6 for 80. A link of exactly that per cent is missed with a probability of
at most `MISS`, and a member of a larger class must be missed by
all its links.

Steps. (1) Equal sets are one class from the start; only its least doc_id goes on. (2) Within each band key every
document is tied to the least one: a tie, not yet a link, and linear in the key's size; keys that many documents
share are dealt out (`components.with_least`). (3) Components of the ties
hold all linked pairs. Each is cut in blocks of about `BLOCK` documents, and each pair of blocks is one group of
bounded size, which gets the full texts, tests pairs that are not connected yet on their full sets (most alike
sketches first) and returns a spanning forest of links, never all pairs. (4) Components of the forests are
the classes. Pairs whose sketches agree in too few bins are not tested; the limit lies six standard deviations
below what that similarity gives.

Defined results: a text without words, empty or null, has an empty set, is linked with nothing and kept; fewer than
five words are one shingle; a row without doc_id can't be linked: it is kept, with a null class; rows that
repeat a doc_id are one node of the graph; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import _arrow
from tesserae.llm._arrow import mix
from tesserae.llm._names import fresh
from tesserae.llm.components import components, with_least
from tesserae.session import checkpoint_ready, table

SHINGLE, PERCENT = 5, 85
#: A link of exactly the asked similarity may be missed with this probability.
MISS = 2.5e-7
BLOCK = 1024
#: Ids of documents that may have a partner are broadcast up to this many bytes, and shuffled beyond.
BROADCAST_BYTES = 64_000_000


@dataclass(frozen=True)
class Plan:
    """What follows from the per cent asked for."""

    percent: int

    @property
    def rows(self) -> int:
        """Bins of a band: a link of exactly `percent` shares a band with a probability of a quarter or a little more."""
        return max(1, math.floor(math.log(0.25) / math.log(self.percent / 100)))

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def bins(self) -> int:
        return self.rows * self.bands

    @property
    def least_agree(self) -> int:
        """Bins that must agree for a pair to be tested."""
        p = self.percent / 100
        return math.floor(self.bins * p - 6 * math.sqrt(self.bins * p * (1 - p)))


ROWS, BANDS = Plan(PERCENT).rows, Plan(PERCENT).bands
T, LEAST_AGREE = Plan(PERCENT).bins, Plan(PERCENT).least_agree

_U = np.uint64


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = _arrow.word_hashes(texts)
    salt = [mix(np.array([k + 1], _U))[0] | _U(1) for k in range(SHINGLE)]
    n = len(words) - SHINGLE + 1
    whole = mix(sum(words[k : n + k] * salt[k] for k in range(SHINGLE))) if n > 0 else np.empty(0, _U)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * np.array(salt[: b - a], _U)).sum(keepdims=True, dtype=_U) + _U(b - a)
            out.append(mix(short ^ _U(0x9E3779B97F4A7C15)))
        else:
            out.append(np.empty(0, _U))
    return out


def sketch_sets(sets: list[np.ndarray], n_bins: int = T) -> np.ndarray:
    """[set, bin] -> the hash that the bin took; rows of empty sets are all ones."""
    none = _U(2**64 - 1)
    out = np.full((len(sets), n_bins), none)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    open_ = np.flatnonzero(sizes)
    items = np.concatenate(sets) if len(sets) else np.empty(0, _U)
    starts = np.cumsum(sizes) - sizes
    for k in range(2 * n_bins):
        if not len(open_):
            break
        mine = items[_arrow.ragged(starts[open_], sizes[open_])]
        hashed = mix(mine ^ mix(np.array([k + 0x51ED27], _U))[0])
        bins = (hashed % _U(n_bins)).astype(np.int64) if k < n_bins else np.full(len(hashed), k - n_bins)
        # at most the hash itself: all ones marks an open bin
        value = np.minimum(mix(hashed ^ _U(0xD6E8FEB86659FD93)), none - _U(1))
        fresh = np.full((len(open_), n_bins), none)
        np.minimum.at(fresh.reshape(-1), np.repeat(np.arange(len(open_)), sizes[open_]) * n_bins + bins, value)
        was = out[open_]
        now = np.where(was == none, fresh, was)
        out[open_] = now
        open_ = open_[(now == none).any(axis=1)]
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[set, band] -> key; the band's number is part of the key."""
    cells = sketches.reshape(len(sketches), bands, rows)
    salt = np.array([int(mix(np.array([k + 77], _U))[0]) | 1 for k in range(rows)], _U)
    return mix((cells * salt).sum(axis=2, dtype=_U) ^ mix(np.arange(bands, dtype=_U) + _U(1))).view(np.int64)


def sketches_of(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class, bands): class is a 128-bit digest of the set, null for an empty one."""
    plan = Plan(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, 1):
                sets = shingle_sets(part.column(1))
                keys = band_keys(sketch_sets(sets, plan.bins), plan.bands, plan.rows)
                full = np.fromiter((len(s) > 0 for s in sets), bool, len(sets))
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * plan.bands)]), pa.int32()), pa.array(keys[full].ravel(), pa.int64()))
                digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), digest, bands], ["doc_id", "n_shingles", "class", "bands"])

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_shingles long, class binary, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is linked; pairs that are connected already are not tested."""
    plan = Plan(percent)
    sketches = (sketch_sets(sets, plan.bins) & _U(0xFFFF)).astype(np.uint16)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(ids) - 1):
        agree = (sketches[i + 1 :] == sketches[i]).sum(axis=1)
        small, large = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        js = np.flatnonzero((agree >= plan.least_agree) & (100 * small >= percent * large))
        if len(js):
            asked.append((agree[js], np.full(len(js), i), js + i + 1))
    links = []
    if asked:
        agree, left, right = (np.concatenate(x) for x in zip(*asked))
        order = np.argsort(-agree, kind="stable")
        for i, j in zip(left[order].tolist(), right[order].tolist()):
            a, b = find(i), find(j)
            if a != b and similar(sets[i], sets[j], percent):
                root[a] = b
                links.append((ids[i], ids[j]))
    return links


def narrow(df: DataFrame) -> DataFrame:
    """Broadcast a table whose bytes were counted; a larger one is joined by shuffling."""
    wide = [F.octet_length(F.col(c).cast("string")) for c, kind in df.dtypes if kind in ("string", "binary")]
    size = df.agg(F.coalesce(F.sum(sum(wide, F.lit(16 + 16 * len(df.columns)))), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links are of `percent` or more."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    kind = df.schema[doc_id].dataType.simpleString()
    drawn = sketches_of(df, doc_id, text, percent).checkpoint()
    lead = drawn.filter("class IS NOT NULL AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    keyed = lead.select("rep", F.explode("bands").alias("key"))
    ties = with_least(keyed, "key", "rep", Plan(percent).bands * drawn.count(), 2).filter("rep != least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    tied = components(ties)
    tied = tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())
    sizes = tied.groupBy(F.col("component").alias("c")).agg(F.ceil(F.count("node") / BLOCK).cast("int").alias("blocks"))
    members = tied.join(sizes, F.col("component") == F.col("c")).select("node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")).checkpoint()
    texts = df.select(F.col(doc_id).alias("__nd_id"), F.col(text).alias("text")).join(narrow(members), F.col("__nd_id") == F.col("node")).select("node", "component", "blocks", "mine", "text")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "text"
    )

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        batches = group.select(["node", "text"]).to_batches()
        sets = [s for b in batches for part in _arrow.slices(b, 1) for s in shingle_sets(part.column(1))]
        found = forest(group["node"].to_pylist(), sets, percent)
        names = group.schema.field("node").type
        return pa.table({"u": pa.array([a for a, _ in found], names), "v": pa.array([b for _, b in found], names)})

    links = dealt.groupBy("component", "i", "j").applyInArrow(verify, f"u {kind}, v {kind}")
    found = components(links)
    reps = lead.select("class", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("class").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    out = drawn.select("doc_id", "n_shingles", "class").join(reps, F.col("class") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each class, that of the least doc_id, with the columns it had; rows without doc_id all stay."""
    key, rows = fresh(df, "kept", "rows")
    kept = classes(df, doc_id, text, percent).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key))
    kept = kept.groupBy(key).agg(F.count(F.lit(1)).alias(rows)).checkpoint()
    most = kept.agg(F.max(rows)).first()[0] or 0
    found = df.join(narrow(kept), F.col(doc_id) == F.col(key))
    if most > 1:  # only rows that repeat a doc_id need to be brought together
        found = found.filter(F.col(rows) == 1).unionByName(found.filter(F.col(rows) > 1).dropDuplicates([doc_id]))
    return found.drop(key, rows).unionByName(df.filter(F.col(doc_id).isNull()))


#: DuckDB: pairs by shared shingles, and the least doc_id reachable over links.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid
), p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid
), l AS (
  SELECT dx.doc_id AS u, dy.doc_id AS v FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y JOIN d dx ON dx.rid = x JOIN d dy ON dy.rid = y
  WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)
), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l
), r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.u, r.c FROM r JOIN e ON e.v = r.id
), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id IS NOT DISTINCT FROM c AS kept FROM d LEFT JOIN n USING (rid) LEFT JOIN m ON m.id = d.doc_id
"""
