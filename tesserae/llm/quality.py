"""Quality rules as a short-circuit cascade, in Spark expressions only.

A rule is a name and a function of the text and its words to a boolean that is true where the rule rejects.
`plan_cascade` measures on a bounded sample what each rule costs and how many rows it rejects, and orders the
rules by rejection per cost (the order that minimises the expected cost of a conjunction of independent
filters); `cascade` then evaluates them in a CASE chain, which stops at the first rule that rejects. The order
changes cost only, never the verdict, so a timing that varies between runs cannot change results.

Defined results: a null or empty text has no words and is rejected by `few_words`; repeated rows are judged one
by one; an empty table gives an empty table; other columns pass through whatever their names, but for the
statistics' own, which are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm._names import fresh
from tesserae.session import table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Production parameters.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_10_WORDS = 1
MAX_SHOUTS_PER_2_WORDS = 1
MAX_DUP_LINE_PERCENT = 50
MIN_WORD_CHARS, MAX_WORD_CHARS = 2, 30
SAMPLE_ROWS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once, so that lambdas inside `body` do not evaluate it for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of non-blank characters."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def count_of(text: Column, chars: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def word_chars_of(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def dup_lines_of(text: Column) -> Column:
    return let(lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words_of(words: Column) -> Column:
    """Words that stand in a three-word window whose words occur as a window twice or more.

    A text whose windows all have distinct hashes has no equal windows and is done. Otherwise windows become strings;
    sorting (window, place) puts equal ones side by side, and the places of those that have an equal neighbour are
    widened to the three words each covers. Everything is linear but for the sort.
    """

    def zipped(w: Column) -> Column:
        n = F.size(w) - 2
        return F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(zipped(w), lambda x, i: F.struct(F.concat_ws(" ", x["0"], x["1"], x["2"]).alias("w"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["w"] == F.get(s, b)["w"]
            hits = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.coalesce(same(k - 1, k), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
            )
            at = F.transform(hits, lambda k: F.get(s, k)["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return let(pairs, places)

    def counted(w: Column) -> Column:
        hashes = F.transform(zipped(w), lambda x: F.xxhash64(x["0"], x["1"], x["2"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(w) - 2, F.lit(0)).otherwise(covered(w))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted(words)).cast("long")


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < MIN_WORDS


def repetitive(text: Column, words: Column) -> Column:
    return 100 * repeat_words_of(words) > MAX_REPEAT_PERCENT * F.size(words)


def symbol_heavy(text: Column, words: Column) -> Column:
    return 10 * count_of(text, SYMBOLS) > MAX_SYMBOLS_PER_10_WORDS * F.size(words)


def shouting(text: Column, words: Column) -> Column:
    return 2 * count_of(text, "!") > MAX_SHOUTS_PER_2_WORDS * F.size(words)


def line_copies(text: Column, words: Column) -> Column:
    return let(lines_of(text), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > MAX_DUP_LINE_PERCENT * F.size(x))


def odd_word_length(text: Column, words: Column) -> Column:
    n = F.size(words)
    return (word_chars_of(text) < MIN_WORD_CHARS * n) | (word_chars_of(text) > MAX_WORD_CHARS * n)


BASE_RULES = {"few_words": few_words, "repetitive": repetitive}
METHOD_RULES = {"symbol_heavy": symbol_heavy, "shouting": shouting, "line_copies": line_copies, "odd_word_length": odd_word_length}
RULES = BASE_RULES | METHOD_RULES


def plan_cascade(df: DataFrame, text: str = "text", rules: dict | None = None, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules in the order of rejection per cost, with what was measured.

    The sample is the first `sample_rows` rows that a scan yields: partitions are read one by one until there are
    enough, so no pass over the table is made. It steers cost only. Each rule runs alone over the sample, which is
    kept as a local table; its cost is the best of two timings.
    """
    rules = RULES if rules is None else rules
    session = df.sparkSession
    first = df.select(F.col(text).alias("text"))._jdf.limit(sample_rows)
    sample = DataFrame(session._jsparkSession.createDataFrame(first.collectAsList(), first.schema()), session)
    sample = sample.withColumn("words", words_of(F.col("text"))).persist()  # all rules share the words
    total = sample.count()
    found = []
    for name, rule in rules.items():
        asked = sample.agg(F.count_if(rule(F.col("text"), F.col("words"))).alias("n"))
        times = []
        for _ in range(2):
            began = time.perf_counter()
            rejected = asked.first()["n"]
            times.append(time.perf_counter() - began)
        found.append({"rule": name, "cost_s": min(times), "rejects": rejected / total if total else 0.0})
    sample.unpersist()
    return sorted(found, key=lambda x: (-x["rejects"] / max(x["cost_s"], 1e-9), x["cost_s"], x["rule"]))


def verdict(text: Column, order: list[str], rules: dict | None = None, words: Column | None = None, first: Column | None = None) -> Column:
    """True where no rule rejects; rules after the first that rejects are not evaluated. The words are found once."""
    rules = RULES if rules is None else rules

    def chained(w: Column) -> Column:
        chain = F.when(first, F.lit(False)) if first is not None else None
        for name in order:
            rejects = F.coalesce(rules[name](text, w), F.lit(False))
            chain = F.when(rejects, F.lit(False)) if chain is None else chain.when(rejects, F.lit(False))
        return F.lit(True) if chain is None else chain.otherwise(F.lit(True))

    return chained(words) if words is not None else let(words_of(text), chained)


def cascade(df: DataFrame, text: str = "text", rules: dict | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows that no rule rejects, with the columns they had."""
    order = [x["rule"] for x in plan_cascade(df, text, rules, sample_rows)]
    return df.filter(verdict(df[text], order, rules))


def with_statistics(df: DataFrame, text: str = "text", out_prefix: str = "", words: str | None = None) -> DataFrame:
    """The base statistics beside every row; `words` names a column in which the words stay."""
    c, p = df[text], out_prefix
    held = words or fresh(df, "words")[0]
    found = df.withColumn(held, words_of(c)).withColumns(
        {
            f"{p}n_words": F.size(held).cast("long"),
            f"{p}word_chars": word_chars_of(c),
            f"{p}n_symbols": count_of(c, SYMBOLS),
            f"{p}n_dup_lines": dup_lines_of(c),
            f"{p}n_repeat_words": repeat_words_of(F.col(held)),
        }
    )
    return found if words else found.drop(held)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [x["rule"] for x in plan_cascade(docs, rules=METHOD_RULES)]
    found = with_statistics(docs, words="words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    kept = verdict(F.col("text"), order, METHOD_RULES, F.col("words"), F.col("base_failed"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


#: DuckDB: the same statistics by exploding words and windows; `kept` by the rules' arithmetic.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), t AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM t) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), s AS (
  SELECT doc_id, text, len(words)::BIGINT AS n_words,
    length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    (length(text) - length(replace(text, '!', ''))) AS shouts,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (2 * shouts > n_words)
  AND NOT (100 * n_dup_lines > 50 * n_lines) AND NOT (word_chars < 2 * n_words OR word_chars > 30 * n_words) AS kept
FROM b
"""
