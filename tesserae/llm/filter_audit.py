"""How filters interact: what every order of five filters removes at each step, by part and label.

Each document fails some of n filters, which is a number below 2^n. A table, made once, holds for each such number
and each of the n! orders the step of the first failure. Tasks look their rows up in it, `np.bincount` adds up
removals by part, order, step and label, and the tasks' partial arrays, whose size does not depend on the rows, are
summed by Spark. No text is compared with another: texts meet as digests, and a group of copies of any size is one
least doc_id and a join that Spark may split.

Defined results: a null text is empty, a null lang the part ''. Text counts ignore doc_id. A document is a copy if its
text stands under a smaller doc_id; rows without doc_id are no copies and make none, and rows that repeat a doc_id and
text are copies only of smaller ones. Labels that repeat a doc_id count as one if any row says so; labels without
doc_id or of unknown documents count nothing. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import checkpoint_ready, table

#: Letters of the filters, in the order of their bits.
LETTERS = "ABCDE"
#: Limits of the filters: least words, least distinct words and most capitals in per cent, symbols that none may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
#: Parts that a task holds before it hands its counts on.
MOST_PARTS = 2048
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(n: int) -> np.ndarray:
    """All orders of n filters, n! by n."""
    return np.array(list(itertools.permutations(range(n))), np.int64).reshape(-1, n)


def first_failure(n: int) -> np.ndarray:
    """2^n by n!: the step (from 0) at which a document with these failures goes; n if it stays."""
    failing = np.arange(2**n)[:, None, None] >> orders(n)[None] & 1
    return np.where(failing.any(2), failing.argmax(2), n)


def measured(cells: np.ndarray, n: int, table: np.ndarray) -> dict[str, np.ndarray]:
    """Each measure as an array (part, order, step), of cells (part, failures, label); label: 1 good, 2 toxic, 3 both."""
    parts, runs = len(cells), orders(n)
    at = (np.arange(parts)[:, None, None] * len(runs) + np.arange(len(runs))) * (n + 1) + table

    def removals(of: np.ndarray) -> np.ndarray:
        spread = np.broadcast_to(of[:, :, None], at.shape).ravel()
        return np.bincount(at.ravel(), spread, parts * len(runs) * (n + 1)).astype(np.int64).reshape(parts, len(runs), n + 1)[:, :, :n]

    every = cells.sum(2)
    removed = removals(every)
    failing = every @ (np.arange(2**n)[:, None] >> np.arange(n) & 1)
    by_filter = np.stack([removed[:, runs == f].sum(1) for f in range(n)], 1)
    return {
        "kept": every.sum(1)[:, None, None] - removed.cumsum(2),
        "removed": removed,
        "redundant": failing[:, runs] - removed,
        "unique_fails": every[:, 1 << np.arange(n)][:, runs],
        "good_lost": removals(cells[:, :, 1] + cells[:, :, 3]),
        "toxic_lost": removals(cells[:, :, 2] + cells[:, :, 3]),
        "shapley": by_filter[:, runs],
    }


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, MEASURES) of rows (part string, failures int with a bit for each letter, label int)."""
    n, table = len(letters), first_failure(len(letters))
    names = ["".join(letters[f] for f in run) for run in orders(n)]

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        cells = np.zeros((0, 2**n, 4), np.int64)
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            place = np.array([places.setdefault(x, len(places)) for x in coded.dictionary.to_pylist()], np.int64)
            if batch.num_rows:
                key = (place[coded.indices.to_numpy()] * 2**n + batch.column(1).to_numpy()) * 4 + batch.column(2).to_numpy()
                found = np.bincount(key, minlength=len(places) * 2**n * 4).reshape(-1, 2**n, 4)
                found[: len(cells)] += cells
                cells = found
            if len(places) > MOST_PARTS:
                yield from told(list(places), cells)
                places, cells = {}, cells[:0]
        yield from told(list(places), cells)

    def told(parts: list[str], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(parts):
            counts = measured(cells[k : k + 1], n, table)
            columns = [pa.array([part] * (len(names) * n)), pa.array(np.repeat(names, n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names)))]
            yield pa.record_batch(columns + [pa.array(counts[m].ravel()) for m in MEASURES], ["part", "filter_order", "step", *MEASURES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    partial = rows.select("part", F.col("failures").cast("long"), F.col("label").cast("long")).mapInArrow(tally, schema)
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(m).alias(m) for m in MEASURES])


def text_failures(text: Column) -> Column:
    """Bits of the filters that need the text alone."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < LEAST_WORDS, F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT, capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS, text.rlike(SYMBOLS)]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failures, label) of every document."""
    checkpoint_ready(docs.sparkSession)
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    facts = text.select("doc_id", "part", text_failures(F.col("text")).alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")).checkpoint()
    copied = facts.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("doc_id").alias("n")).filter("n > 1").select("digest", "low")
    flags = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = facts.join(copied, "digest", "left").join(flags, "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("low"), F.lit(1 << 4)).otherwise(F.lit(0))
    return known.select("part", (F.col("fails") + copy).alias("failures"), (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))).alias("label"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all 120 orders of the five filters over `documents`, by lang."""
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (
    SELECT body, min(doc_id) AS low FROM words GROUP BY body
), flags AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body))::INT
           + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(words.doc_id > low, false)::INT AS mask
    FROM words JOIN least USING (body) LEFT JOIN flags ON flags.doc_id = words.doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS g, count(*) FILTER (toxic = 1) AS t FROM failing GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), runs AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), bits AS (
    SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
           list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END))::INT AS before
    FROM runs, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(g) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(t) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM cells, bits GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
"""
