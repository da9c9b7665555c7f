"""Relational operators the analyses share, over any tables: the caller names the columns.

Each is a composition of built-in operators. Ties are never left to chance: an order that must be total takes
all the columns it needs, and operators that keep ties say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.scalars import ancestors
from tesserae.session import checkpoint_ready

#: Most rows of a table that is turned into literals or broadcast; larger ones are joined.
SMALL_ROWS = 10_000


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The size of each key's group, keys under other names; counted before any shuffle."""
    return df.groupBy(*[F.col(k).alias(f"__c_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(name))


def same_key(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__c_{k}")) for k in keys]


def first_with_count(df: DataFrame, keys: list[str], order: list[Column], count: str = "n") -> DataFrame:
    """The first row of each key and the size of its group.

    Tasks cut their rows down to the first of each key before these meet (a window's group limit), and sizes are joined
    on afterwards, so that a large group is never in one task.
    """
    first = first_per_key(df, keys, order)
    return first.join(counted(df, keys, count), same_key(keys)).drop(*[f"__c_{k}" for k in keys])


def first_with_ties(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows that share the first place of their key."""
    return df.withColumn("__n", F.rank().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, more: str = "n_more") -> DataFrame:
    """The first k rows of each key, with how many more there are; see first_with_count."""
    top = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")
    out = top.join(counted(df, keys, "__size"), same_key(keys)).drop(*[f"__c_{k}" for k in keys])
    return out.withColumn(more, F.greatest(F.col("__size") - k, F.lit(0))).drop("__size")


def complete(df: DataFrame, domain: DataFrame, keys: list[str], zeros: list[str]) -> DataFrame:
    """Every key of the domain, with zeros where the aggregate has no row."""
    out = domain.select(*keys).distinct().join(df, keys, "left")
    return out.withColumns({z: F.coalesce(z, F.lit(0)) for z in zeros})


def longest_prefix(df: DataFrame, value: str, patterns: DataFrame, pattern: str, exact: str | None = None, source: str | None = None) -> DataFrame:
    """Each row with the longest pattern that begins its value; an exact match beats prefixes, and lower sources win ties.

    A value is exploded into its own prefixes of the lengths that patterns have, which turns the search into an
    equi-join: no pair of value and pattern is compared that does not match. exact: a boolean column of patterns that
    only match whole values.
    """
    lengths = [r[0] for r in patterns.select(F.length(pattern)).distinct().limit(SMALL_ROWS + 1).collect() if r[0]]
    if len(lengths) > SMALL_ROWS:
        raise ValueError(f"patterns of more than {SMALL_ROWS} lengths")
    cols = [F.col(c).alias(f"__p_{c}") for c in patterns.columns]
    values = df.select(F.col(value).alias("__v")).filter("__v IS NOT NULL").distinct()
    tried = F.array_distinct(F.array(*[F.substring("__v", 1, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    hits = values.select("__v", F.explode(tried).alias("__try")).join(patterns.select(*cols), F.col("__try") == F.col(f"__p_{pattern}"))
    if exact:
        hits = hits.filter(~F.col(f"__p_{exact}") | (F.col("__try") == F.col("__v")))
    order = [(F.col("__try") == F.col("__v")).desc(), F.length("__try").desc(), *([F.col(f"__p_{source}")] if source else [])]
    best = first_per_key(hits, ["__v"], [*order, *[F.col(f"__p_{c}") for c in patterns.columns if c != source]])
    # rows meet their pattern by value, so no row needs a number of its own
    return df.join(best.drop("__try"), F.col(value) == F.col("__v"), "left").drop("__v").withColumnsRenamed({f"__p_{c}": c for c in patterns.columns})


def deepest_owner(paths: DataFrame, path: str, owners: DataFrame, folder: str, ties: bool = False, tie_break: str | None = None) -> DataFrame:
    """Paths with the owner of their deepest owned folder: a path's ancestors are exploded and joined by equality."""
    tried = paths.select(path, F.explode(ancestors(F.col(path))).alias("__at"))
    found = tried.join(owners, F.col("__at") == F.col(folder)).withColumn("__depth", F.when(F.col("__at") == ".", 0).otherwise(F.size(F.split("__at", "/"))))
    order = [F.desc("__depth")] + ([] if ties else [F.col(tie_break or folder)])
    return (first_with_ties if ties else first_per_key)(found, [path], order).drop("__at", "__depth")


def as_of(df: DataFrame, at: str, segments: DataFrame, begins: str, label: str, out: str) -> DataFrame:
    """The label of the last segment that begins at or before each row's value; a null begin is minus infinity.

    Segments are few by nature (their number is checked): they become one sorted literal and need no join.
    """
    rows = segments.select(F.col(begins), F.col(label)).orderBy(F.col(begins).asc_nulls_first()).limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} segments")
    floor = [r[1] for r in rows if r[0] is None]
    known = [(r[0], r[1]) for r in rows if r[0] is not None]
    if not known:
        return df.withColumn(out, F.lit(floor[-1] if floor else None))
    place = F.size(F.filter(F.array(*[F.lit(b) for b, _ in known]), lambda b: b <= F.col(at)))
    labels = F.array(*[F.lit(x) for _, x in known])
    return df.withColumn(out, F.when(F.col(at).isNull(), None).when(place == 0, F.lit(floor[-1] if floor else None)).otherwise(F.get(labels, place - 1)))


def satisfies_all(candidates: DataFrame, ranges: DataFrame, key: str, value: str, low: str, high: str) -> DataFrame:
    """Candidates of a key within every range of that key; null bounds are open, and a key without ranges asks nothing."""
    ok = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))
    asked = ranges.select(F.col(key).alias("__k"), low, high)
    return candidates.join(asked, F.col(key) == F.col("__k"), "left").groupBy(*candidates.columns).agg(F.bool_and(F.col("__k").isNull() | ok).alias("__ok")).filter("__ok").drop("__ok")


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed, from one full outer join."""
    a = before.select(F.col(key).alias("__a"), F.col(value).alias("__va"))
    b = after.select(F.col(key).alias("__b"), F.col(value).alias("__vb"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__va").eqNullSafe(F.col("__vb")), "changed")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), change.alias("change")).filter("change IS NOT NULL")


def not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a partner; nulls are equal to nulls."""
    asked = other.select(*[F.col(k).alias(f"__o_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys]
    return df.join(asked, on, "left_anti")


def baseline(current: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side with their standing: known, new or fixed."""
    sides = current.select(*keys).distinct().withColumn("__side", F.lit(1)).unionByName(known.select(*keys).distinct().withColumn("__side", F.lit(2)))
    standing = F.when(F.col("__s") == 3, "known").when(F.col("__s") == 1, "new").otherwise("fixed")
    return sides.groupBy(*keys).agg(F.sum("__side").alias("__s")).withColumn("standing", standing).drop("__s")


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same rows, however often each."""
    return not_in(a, b, a.columns).isEmpty() and not_in(b, a, a.columns).isEmpty()


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers: (keys, first, last, n)."""
    rows = df.select(*keys, at).distinct()
    shift = rows.withColumn("__run", F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at)))
    return shift.groupBy(*keys, "__run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(at).alias("n")).drop("__run")


def numbered(df: DataFrame, order: list[Column], name: str = "n", begin: int = 1) -> DataFrame:
    """Rows numbered in a global total order without bringing them into one task.

    Rows are sorted into ranges, numbered within each range, and moved up by the sizes of the ranges before it; only
    these sizes, one for each partition, reach the driver.
    """
    checkpoint_ready(df.sparkSession)
    # the id holds the partition in its upper bits and the place there in the lower 33
    ranged = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets += [F.lit(p), F.lit(total).cast("long")]
        total += n
    shift = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return ranged.withColumn(name, place + shift + begin).drop("__id")


def chunked(df: DataFrame, order: list[Column], size: int, name: str = "chunk") -> DataFrame:
    return numbered(df, order, "__c", 0).withColumn(name, F.floor(F.col("__c") / size)).drop("__c")


def first_answer(df: DataFrame, key: str, lookups: list[DataFrame], answer: str, out: str = "answer") -> DataFrame:
    """Ask lookups (key, answer) in turn; the first that knows a key answers, and `out`_source tells which."""
    cols = []
    for i, lookup in enumerate(lookups):
        unique = lookup.groupBy(F.col(key).alias(f"__k{i}")).agg(F.min(answer).alias(f"__a{i}"))
        df = df.join(unique, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        cols.append(f"__a{i}")
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(cols)])
    return df.withColumns({out: F.coalesce(*cols), f"{out}_source": which}).drop(*cols)


def few(df: DataFrame, column: str) -> Column:
    """The distinct values of a column as one array; more of them than `SMALL_ROWS` are refused."""
    held = [r[0] for r in df.select(column).distinct().limit(SMALL_ROWS + 1).collect()]
    if len(held) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} of {column}")
    return F.array(*map(F.lit, held)).cast(f"array<{df.schema[column].dataType.simpleString()}>")


def compatible(targets: DataFrame, assets: DataFrame, relation: DataFrame) -> DataFrame:
    """(package, version, target, supports): any asset fits the target; a version without assets fits all.

    assets (package, version, framework), relation (target, framework): pairs that fit. Targets are few by nature; their
    number is checked, and each version is exploded to all of them, which is the answer's size.
    """
    versions = assets.select("package", "version").distinct().withColumn("target", F.explode(few(targets, "target")))
    fits = assets.filter("framework IS NOT NULL").join(relation.select(F.col("framework").alias("__f"), F.col("target").alias("__t")), F.col("framework") == F.col("__f"), "left")
    held = fits.groupBy(F.col("package").alias("__p"), F.col("version").alias("__v")).agg(F.collect_set("__t").alias("__ts"))
    out = versions.join(held, (F.col("package") == F.col("__p")) & (F.col("version") == F.col("__v")), "left")
    return out.select("package", "version", "target", F.coalesce(F.array_contains("__ts", F.col("target")), F.lit(True)).alias("supports"))


def majority(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """The choice with most votes for each key, the least by name among equals; votes are counted before any window."""
    counted = votes.groupBy(key, choice).agg(F.count(F.lit(1)).alias("votes"))
    return first_per_key(counted, [key], [F.desc("votes"), F.col(choice)])


def covering(candidates: DataFrame, key: str, member: str, flawed: DataFrame | None = None) -> DataFrame:
    """Of sets (key, member), the one that contains every other, else the strictly largest; `choice` tells how, or that it is a tie.

    flawed: a one-column frame of keys that are set aside, unless there are no others.
    """
    if flawed is not None:
        sound = candidates.join(flawed.select(F.col(flawed.columns[0]).alias("__f")).distinct(), F.col(key) == F.col("__f"), "left_anti")
        candidates = candidates if sound.isEmpty() else sound
    sizes = candidates.distinct().groupBy(key).agg(F.countDistinct(member).alias("n"))
    total = candidates.select(member).distinct().count()
    top = sizes.agg(F.max("n").alias("top"), F.max_by(key, F.struct("n", key)).alias(key)).first()
    if top["top"] is None:
        return sizes.select(key, "n", F.lit("").alias("choice"))
    equal = sizes.filter(F.col("n") == top["top"])
    how = F.when(F.col("n") == total, "covers").otherwise("largest")
    many = equal.count() > 1
    return equal.select(key, "n", F.when(F.lit(many), "tie").otherwise(how).alias("choice"))
