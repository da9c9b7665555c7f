"""Which members can cross a network boundary as data, and why the others can't.

Types are written as text, with type arguments in angle brackets. Containers are taken off from the outside in, by one
expression over as many steps as a text has layers; what is left is a name: simple, known by its table, or unknown. A
class or struct crosses if all its public properties are settable and cross; a type that comes back to itself on the
way counts as if it did. Reasons travel up: each type that can't cross tells its first such property, and that one's
reason behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import distances, gathered, reverse, scc
from tesserae.operators.relational import first_per_key
from tesserae.session import checkpoint_ready

# Names that cross as they are, containers that cross if what they hold does, and maps.
SIMPLE = "bool byte sbyte short ushort int uint long ulong char float double decimal string void System.DateTime System.DateTimeOffset System.TimeSpan System.Guid System.Uri System.Threading.CancellationToken".split()
SEQUENCES = "List IList IReadOnlyList IEnumerable ICollection IReadOnlyCollection HashSet ISet".split()
MAPS = "Dictionary IDictionary IReadOnlyDictionary".split()
AWAITED = "System.Threading.Tasks.Task System.Threading.Tasks.ValueTask".split()
HANDLES = "nint nuint System.IntPtr System.UIntPtr".split()
COLLECTIONS, FILES, KEYS = "System.Collections.Generic.", "System.IO.", "dictionaries need string keys"

_ONE = "|".join([*(f"System\\.Collections\\.Generic\\.{n}" for n in SEQUENCES), "System\\.Nullable", *(a.replace(".", "\\.") for a in AWAITED)])
_MAP = "|".join(f"System\\.Collections\\.Generic\\.{n}" for n in MAPS)


def unwrapped(text: Column) -> Column:
    """struct(name, why): the name inside all containers, arrays and nullable marks, or why a container can't cross."""
    layers = F.length(text) - F.length(F.translate(text, "<[?", ""))
    begin = F.struct(F.trim(text).alias("name"), F.lit(None).cast("string").alias("why"))
    one, pair = rf"^(?:{_ONE})<(.*)>$", rf"^(?:{_MAP})<\s*(?:string|System\.String)\s*,(.*)>$"

    def step(acc: Column, _: Column) -> Column:
        name = acc["name"]
        inner = F.when(name.rlike(r"\[[,\s]*\]$"), F.regexp_replace(name, r"\[[,\s]*\]$", "")).when(name.endswith("?"), F.regexp_replace(name, r"\?$", "")).when(name.rlike(one), F.regexp_extract(name, one, 1)).when(name.rlike(pair), F.regexp_extract(name, pair, 1)).otherwise(name)
        bad = ~name.rlike(r"(\]|\?)$") & name.rlike(rf"^(?:{_MAP})<.*>$") & ~name.rlike(pair)
        return F.when(acc["why"].isNotNull(), acc).otherwise(F.struct(F.trim(inner).alias("name"), F.when(bad, F.lit(KEYS)).alias("why")))

    return F.aggregate(F.sequence(F.lit(0), F.coalesce(layers, F.lit(0))), begin, step)


def leaf_problem(name: Column, kind: Column) -> Column:
    """Why a name that isn't a class or struct of the table can't cross, or null. kind: of the table, null for unknown names."""
    return (
        F.when(name.isin("object", "System.Object"), F.lit("object has no wire shape"))
        .when(name.isin(*SIMPLE, *AWAITED) | kind.isin("simple", "enum"), F.lit(None))
        .when(name.isin(*HANDLES), F.concat(name, F.lit(" is a native handle")))
        .when(name.endswith("*") | (kind == "pointer"), F.lit("pointers cannot cross the wire"))
        .when(kind == "delegate", F.concat(name, F.lit(" is a delegate")))
        .when(name.startswith(FILES), F.concat(name, F.lit(" is a stream or file handle")))
        .when(kind == "interface", F.concat(name, F.lit(" is an interface")))
        .when(kind.isin("class", "struct"), F.lit(None))
        .otherwise(F.concat(name, F.lit(" has no wire shape")))
    )


def type_problems(types: DataFrame, properties: DataFrame) -> DataFrame:
    """(type, why): the reason of each class or struct that can't cross; the others have no row.

    types (type, kind: simple, enum, class, struct, abstract, interface, delegate or pointer, has_events), properties
    (type, place, property, of, settable): public properties of an instance, in the order of declaration.
    """
    checkpoint_ready(types.sparkSession)
    known = types.dropDuplicates(["type"]).select("type", "kind", F.coalesce("has_events", F.lit(False)).alias("has_events")).checkpoint()
    data = known.filter("kind IN ('class', 'struct')").filter(~F.col("type").startswith(FILES)).filter(~F.col("type").isin(*SIMPLE, *AWAITED, *HANDLES))
    at = properties.withColumn("x", unwrapped(F.col("of"))).select("type", "place", "property", "settable", F.col("x.name").alias("name"), F.col("x.why").alias("why"))
    at = at.join(data.select(F.col("type").alias("t")), F.col("type") == F.col("t"), "left_semi")
    kinds, inner = known.select(F.col("type").alias("k"), "kind"), data.select(F.col("type").alias("d"))
    at = at.join(kinds, F.col("name") == F.col("k"), "left").join(inner, F.col("name") == F.col("d"), "left")
    own = F.when(~F.coalesce("settable", F.lit(False)), F.concat("type", F.lit("."), "property", F.lit(" has no public setter"))).otherwise(
        F.concat("type", F.lit("."), "property", F.lit(": "), F.coalesce("why", F.when(F.col("d").isNull(), leaf_problem(F.col("name"), F.col("kind")))))
    )
    at = at.select("type", "place", "property", own.alias("own"), F.when(F.col("why").isNull() & F.coalesce("settable", F.lit(False)), F.col("d")).alias("of")).checkpoint()
    some = at.select(F.col("type").alias("s")).distinct()
    empty = data.join(some, F.col("type") == F.col("s"), "left_anti").select("type", F.concat("type", F.lit(" has no public properties")).alias("why"))
    events = data.filter("has_events").select("type", F.concat("type", F.lit(" has events")).alias("why"))
    seeds = empty.select("type").unionByName(events.select("type")).unionByName(at.filter("own IS NOT NULL").select("type"))
    edges = at.filter("of IS NOT NULL AND own IS NULL").select(F.col("type").alias("src"), F.col("of").alias("dst")).distinct().checkpoint()
    rank = distances(reverse(edges), seeds).select(F.col("node").alias("n"), F.col("distance").alias("rank")).checkpoint()
    ring = scc(edges).select(F.col("node").alias("m"), F.col("component").alias("ring"))
    # a property on a way back counts only if its type can be told without this one
    a, b = rank.select(F.col("n").alias("na"), F.col("rank").alias("ra")), rank.select(F.col("n").alias("nb"), F.col("rank").alias("rb"))
    r1, r2 = ring.select(F.col("m").alias("m1"), F.col("ring").alias("g1")), ring.select(F.col("m").alias("m2"), F.col("ring").alias("g2"))
    tried = at.join(a, F.col("type") == F.col("na")).join(b, F.col("of") == F.col("nb"), "left").join(r1, F.col("type") == F.col("m1"), "left").join(r2, F.col("of") == F.col("m2"), "left")
    through = F.col("rb").isNotNull() & (~F.coalesce(F.col("g1") == F.col("g2"), F.lit(False)) | (F.col("rb") < F.col("ra")))
    first = first_per_key(tried.filter(F.col("own").isNotNull() | through), ["type"], [F.col("place"), F.col("property")])
    first = first.select("type", "own", F.concat("type", F.lit("."), "property", F.lit(": ")).alias("lead"), "of").checkpoint()
    told = first.select(F.col("type").alias("f"))
    late = events.join(told, F.col("type") == F.col("f"), "left_anti")
    new = empty.unionByName(late).unionByName(first.filter("own IS NOT NULL").select("type", F.col("own").alias("why"))).checkpoint()
    waiting, parts = first.filter("own IS NULL").select("type", "lead", "of").checkpoint(), [new]
    while not new.isEmpty():
        new = waiting.join(new.select(F.col("type").alias("o"), F.col("why").alias("behind")), F.col("of") == F.col("o")).select("type", F.concat("lead", "behind").alias("why")).checkpoint()
        parts.append(new)
    return gathered(parts)


def wire_problems(members: DataFrame, types: DataFrame, properties: DataFrame) -> DataFrame:
    """(member, problems): what keeps each member from crossing, in the order of its parts; empty if nothing does.

    members (member, place, part, name, type, by): part is parameter, return, property, field or event; by tells how a
    parameter that isn't passed by value is passed.
    """
    why = type_problems(types, properties).select(F.col("type").alias("t"), F.col("why").alias("deep"))
    kinds = types.dropDuplicates(["type"]).select(F.col("type").alias("k"), "kind")
    rows = members.withColumn("x", unwrapped(F.col("type"))).join(why, F.col("x.name") == F.col("t"), "left").join(kinds, F.col("x.name") == F.col("k"), "left")
    reason = F.coalesce("x.why", "deep", leaf_problem(F.col("x.name"), F.col("kind")))
    problem = (
        F.when(F.col("part") == "event", "events cannot cross the wire")
        .when((F.col("part") == "parameter") & F.col("by").isNotNull(), F.concat(F.lit("'"), "name", F.lit("' is passed by "), F.lower("by")))
        .when(F.col("part") == "parameter", F.concat(F.lit("'"), "name", F.lit("': "), reason))
        .when(F.col("part") == "return", F.concat(F.lit("return: "), reason))
        .otherwise(reason)
    )
    found = F.array_sort(F.collect_list(F.struct("place", problem.alias("problem"))))
    return rows.groupBy("member").agg(F.transform(F.filter(found, lambda p: p["problem"].isNotNull()), lambda p: p["problem"]).alias("problems"))
