"""Language-model scoring: stupid backoff over n-gram count tables that are partitioned by hash.

Words are runs of non-blanks with A-Z in lower case; n-grams are words and word pairs, as 64-bit hashes. Texts are
dealt into blocks of about `BLOCK_BYTES` bytes by a hash. Each block sends its distinct n-grams with their counts
there to the n-gram's hash partition (aggregation before the shuffle: however often a pair occurs, a block sends it
once). A partition of the count table adds up the blocks' counts and joins the totals back to each block's n-grams.
The block, joined with its totals, explodes its texts into n-grams again and sums their scores for every text.
What is gathered so is the corpus's whole table, in partitions that grow in number, not in size. A block sends a row
to each partition that it has n-grams for, so rows never outnumber the distinct n-grams of the blocks.

Scores leave the scored text's own counts out, so that a text can't vouch for itself. With C the counts in all
other rows and N their words: a pair (v, w) scores C(v, w) / C(v) if C(v, w) > 0, else `ALPHA` times the score of w;
w scores C(w) / N if C(w) > 0, else ALPHA / (N + 1). A text's first word has no pair and scores as w.

Defined results: a null or empty text has no words, a total of 0 and a null mean; repeated rows are rows of their
own and vouch for one another; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import _arrow
from tesserae.session import table

ALPHA = 0.4
BLOCK_BYTES = 4_000_000
#: Blocks to a partition of the count table.
BLOCKS_PER_PART = 4

_U = np.uint64


def shrunk(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs (told by the first byte), all lowest bytes first.

    Upper bytes, mostly zeros, stand together, so that the shuffle compresses them away.
    """
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max()) >> (8 * w) == 0)
    return bytes([width]) + np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def grown(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{data[0]}").astype(_U)


class Block:
    """A block's words and pairs, and its sorted distinct n-grams."""

    def __init__(self, texts: pa.Array):
        parts = [_arrow.word_hashes(p.column(0)) for p in _arrow.slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0)]
        words = np.concatenate([w for w, _ in parts]) if parts else np.empty(0, _U)
        self.sizes = np.concatenate([np.diff(at) for _, at in parts]) if parts else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inner = self.owner[1:] == self.owner[:-1]  # word k + 1 has a pair with word k
        pairs = _arrow.mix(words[:-1] * _U(0x9E3779B97F4A7C15) + _arrow.mix(words[1:]))[inner]
        self.second = np.flatnonzero(inner) + 1
        self.grams, at, self.counts = np.unique(np.concatenate([words, pairs]), return_inverse=True, return_counts=True)
        self.word, self.pair = at[: len(words)], at[len(words) :]

    def own(self, owner: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in its own text."""
        _, at, n = np.unique(owner * (len(self.grams) + 1) + gram, return_inverse=True, return_counts=True)
        return n[at]

    def scores(self, totals: np.ndarray, corpus: int) -> np.ndarray:
        """Sum of log scores of each text; totals: of the n-grams in the whole corpus."""
        rest = (corpus - self.sizes)[self.owner].astype(float)
        alone = totals[self.word] - self.own(self.owner, self.word)
        single = np.where(alone > 0, np.maximum(alone, 1) / np.maximum(rest, 1), ALPHA / (rest + 1))
        k = self.second
        both = totals[self.pair] - self.own(self.owner[k], self.pair)
        score = single.copy()
        score[k] = np.where(both > 0, np.maximum(both, 1) / np.maximum(alone[k - 1], 1), ALPHA * single[k])
        return np.bincount(self.owner, np.log(score), len(self.sizes))


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every text."""
    kind = df.schema[doc_id].dataType.simpleString()
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = -(-blocks // BLOCKS_PER_PART)
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def send(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block = Block(group["text"].chunk(0))
        # the hash's upper half says which partition; n-grams are sorted, so each partition's are a run
        bounds = np.searchsorted(block.grams >> _U(32), np.array([-(-(k << 32) // parts) for k in range(parts + 1)], _U))
        runs = [(k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        counts = block.counts
        made = pa.table(
            {
                "part": pa.array([k for k, _, _ in runs], pa.int32()),
                "block": pa.array([group["block"][0].as_py()] * len(runs), pa.int32()),
                "grams": pa.array([shrunk(np.diff(block.grams[a:b], prepend=_U(0))) for _, a, b in runs], pa.binary()),
                "counts": pa.array([shrunk(counts[a:b]) for _, a, b in runs], pa.binary()),
            }
        )
        del block
        _arrow.release()
        return made

    sent = docs.groupBy("block").applyInArrow(send, "part int, block int, grams binary, counts binary")

    def total(group: pa.Table) -> pa.Table:
        grams = [np.cumsum(grown(x), dtype=_U) for x in group["grams"].to_pylist()]
        counts = np.concatenate([grown(x) for x in group["counts"].to_pylist()]).astype(np.float64)
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(at, counts).astype(_U)[at]
        ends = np.cumsum([len(x) for x in grams])
        back = [shrunk(x) for x in np.split(sums, ends[:-1])]
        del grams, counts, at
        _arrow.release()
        return pa.table({"block": group["block"], "part": group["part"], "totals": pa.array(back, pa.binary())})

    totals = sent.groupBy("part").applyInArrow(total, "block int, part int, totals binary")
    corpus = docs.agg(F.sum(word_count(F.col("text"))).alias("n")).first()["n"] or 0

    def score(texts: pa.Table, totals: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        if not texts.num_rows:
            return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        block = Block(texts["text"].chunk(0))
        found = totals.sort_by("part")["totals"].to_pylist()
        known = np.concatenate([grown(x) for x in found]).astype(np.int64) if found else np.empty(0, np.int64)
        made = pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(block.sizes, pa.int64()), "log_score": pa.array(block.scores(known, corpus), pa.float64())})
        del block, known, found
        _arrow.release()
        return made

    found = docs.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double")
    return found.withColumn("mean_log_score", F.try_divide("log_score", "n_words"))


def word_count(text):
    """Number of words of a text that isn't null, counted by their last characters."""
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_texts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), t AS (
  SELECT rid, len(words) AS n, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM d)
), total AS (SELECT count(*) AS n FROM t
), c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w
), c2 AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w
), o1 AS (SELECT rid, w, count(*) AS c FROM t GROUP BY rid, w
), o2 AS (SELECT rid, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY rid, v, w
), s AS (
  SELECT t.rid, total.n - t.n AS rest, c1.c - o1.c AS alone, c2.c - o2.c AS pair, cv.c - ov.c AS before
  FROM t CROSS JOIN total JOIN c1 ON c1.w = t.w JOIN o1 ON o1.rid = t.rid AND o1.w = t.w
  LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN o2 ON o2.rid = t.rid AND o2.v = t.v AND o2.w = t.w
  LEFT JOIN c1 cv ON cv.w = t.v LEFT JOIN o1 ov ON ov.rid = t.rid AND ov.w = t.v
), l AS (
  SELECT rid, sum(ln(CASE WHEN pair > 0 THEN pair / before WHEN pair IS NULL THEN single ELSE {ALPHA} * single END)) AS x
  FROM (SELECT *, CASE WHEN alone > 0 THEN alone / rest ELSE {ALPHA} / (rest + 1) END AS single FROM s) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, round(coalesce(x, 0.0), 5) AS log_score, round(x / len(words), 6) AS mean_log_score FROM d LEFT JOIN l USING (rid)
"""
