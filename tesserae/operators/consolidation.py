"""One version for each package, with the reasons: constraints carry the chain that asks for them.

A constraint is (id, project, kind, range, chain). Kinds, the strongest first: `direct`, a project's own reference;
`transitive`, what a resolved package of a project asks, with the shortest way to it from a direct reference;
`selected`, what another package's chosen version asks; `pin`, a pin for all projects. A pin of one project takes that
project's constraints away and asks for nothing; a pin for all leaves them and asks for its own version beside them.
Ids ignore case. Rounds choose, align families and take in what the choices ask, until nothing changes.

A project may be null in `selected` and `pin`. Packages without a version within their constraints are left out of the
choice and told with their conflict. Repeated rows count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import in_range, version_key, version_range
from tesserae.operators.graph import gathered
from tesserae.operators.relational import first_per_key
from tesserae.session import checkpoint_ready

#: Kinds of constraints, in the order in which equal ones decide.
KINDS = ["direct", "transitive", "selected", "pin"]
MAX_ROUNDS = 8
CONSTRAINT = ["id", "project", "kind", "range", "chain"]


def normal(version: Column) -> Column:
    """The version with three numbers, a fourth that isn't 0, and its prerelease label; build data goes."""
    key = version_key(version)
    label = F.regexp_extract(version, r"^\s*[vV]?\d+(?:\.\d+){0,3}(-[0-9A-Za-z.-]+)", 1)
    return F.concat(F.concat_ws(".", key["major"], key["minor"], key["patch"]), F.when(key["revision"] > 0, F.concat(F.lit("."), key["revision"])).otherwise(""), label)


def described(text: Column) -> Column:
    """A range in words: `>= 1.0.0`, `(>= 1.0.0 && < 2.0.0)`, `(= 1.0.0)`."""
    r = version_range(text)
    low, high = normal(r["low"]), normal(r["high"])
    above, below = F.concat(F.when(r["low_in"], ">= ").otherwise("> "), low), F.concat(F.when(r["high_in"], "<= ").otherwise("< "), high)
    both = F.when(r["low_in"] & r["high_in"] & (version_key(r["low"]) == version_key(r["high"])), F.concat(F.lit("= "), low)).otherwise(F.concat_ws(" && ", above, below))
    return F.when(low.isNotNull() & high.isNull() & r["low_in"], above).otherwise(F.concat(F.lit("("), both, F.lit(")")))


def low_key(text: Column) -> Column:
    return version_key(version_range(text)["low"])


def satisfies(version: Column, text: Column) -> Column:
    return in_range(version_key(version), version_range(text))


def package_paths(resolved: DataFrame, needs: DataFrame) -> DataFrame:
    """(project, tfm, key, chain): for each resolved package the shortest way to it from a direct reference, as `id version`.

    resolved (project, tfm, id, version, direct), needs (project, tfm, id, dep_id). Of equally short ways the one whose
    ids come first counts; a package that no direct reference leads to stands alone. key is the id in upper case.
    """
    checkpoint_ready(resolved.sparkSession)
    told = resolved.select("project", "tfm", F.upper("id").alias("key"), F.concat_ws(" ", "id", "version").alias("told"), "direct")
    told = told.groupBy("project", "tfm", "key").agg(F.min("told").alias("told"), F.bool_or("direct").alias("direct")).checkpoint()
    at = ["project", "tfm"]
    steps = needs.select(*at, F.upper("id").alias("low"), F.upper("dep_id").alias("key")).distinct()
    steps = steps.join(told.select(*at, "key", "told"), [*at, "key"]).checkpoint()
    new = told.filter("direct").select(*at, "key", F.array("key").alias("path"), F.array("told").alias("chain")).checkpoint()
    parts = [new]
    while not new.isEmpty():
        now = new.select(*at, F.col("key").alias("low"), "path", "chain")
        found = now.join(steps, [*at, "low"]).select(*at, "key", F.concat("path", F.array("key")).alias("path"), F.concat("chain", F.array("told")).alias("chain"))
        fresh = found.join(gathered(parts).select(*at, "key"), [*at, "key"], "left_anti")
        new = fresh.groupBy(*at, "key").agg(F.min(F.struct("path", "chain")).alias("x")).select(*at, "key", "x.path", "x.chain").checkpoint()
        parts.append(new)
    reached = gathered(parts).select(*at, "key", "chain")
    alone = told.join(reached.select(*at, "key"), [*at, "key"], "left_anti").select(*at, "key", F.array("told").alias("chain"))
    return reached.unionByName(alone)


def named(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose column names one of the ids, with `id` as these spell it."""
    known = ids.select(F.col("id").alias("__id"), F.upper("id").alias("__u")).groupBy("__u").agg(F.min("__id").alias("__id"))
    return rows.join(known, F.upper(F.col(column)) == F.col("__u")).drop("__u").withColumn("id", F.col("__id")).drop("__id")


def direct_constraints(usage: DataFrame) -> DataFrame:
    """usage (id, version, project): never below what a project refers to."""
    chain = F.array(F.concat("project", F.lit(" references "), "id", F.lit(" "), "version"))
    return usage.select("id", "project", F.lit("direct").alias("kind"), F.concat(F.lit("["), "version", F.lit(", )")).alias("range"), chain.alias("chain")).distinct()


def transitive_constraints(ids: DataFrame, resolved: DataFrame, needs: DataFrame) -> DataFrame:
    """Every range that a resolved package asks of one of the ids, with the way to it; needs has a range."""
    paths = package_paths(resolved, needs)
    asked = named(needs.withColumn("key", F.upper("id")).drop("id"), ids, "dep_id")
    chain = F.concat("chain", F.array(F.concat("id", F.lit(" "), described(F.col("range")))))
    return asked.join(paths, ["project", "tfm", "key"]).select("id", "project", F.lit("transitive").alias("kind"), "range", chain.alias("chain")).distinct()


def selected_constraints(ids: DataFrame, chosen: DataFrame, dependencies: DataFrame) -> DataFrame:
    """What chosen versions ask of the ids. dependencies (id, version, dep_id, range)."""
    now = chosen.select(F.upper("id").alias("__u"), F.col("id").alias("other"), F.col("version").alias("__v"))
    rows = dependencies.join(now, (F.upper("id") == F.col("__u")) & (F.col("version") == F.col("__v"))).select("other", "__v", "dep_id", "range")
    rows = named(rows, ids, "dep_id").filter(F.upper("id") != F.upper("other"))
    chain = F.array(F.concat("other", F.lit(" "), normal(F.col("__v"))), F.concat("id", F.lit(" "), described(F.col("range"))))
    return rows.select("id", F.lit(None).cast("string").alias("project"), F.lit("selected").alias("kind"), "range", chain.alias("chain")).distinct()


def global_pins(ids: DataFrame, pins: DataFrame) -> DataFrame:
    """A constraint for each pin without a project, one for an id: of several the least version's text."""
    rows = named(pins.filter("project IS NULL").filter(version_key(F.col("version")).isNotNull()).withColumnRenamed("id", "asked"), ids, "asked")
    one = rows.groupBy("id").agg(F.min("version").alias("version"))
    text = normal(F.col("version"))
    return one.select("id", F.lit(None).cast("string").alias("project"), F.lit("pin").alias("kind"), F.concat(F.lit("["), text, F.lit("]")).alias("range"), F.array(F.concat(F.lit("pinned: "), "id", F.lit(" "), text)).alias("chain"))


def without_pinned(constraints: DataFrame, pins: DataFrame) -> DataFrame:
    """Constraints but those of a project that pins the package itself."""
    own = pins.filter("project IS NOT NULL").filter(version_key(F.col("version")).isNotNull())
    own = own.select(F.upper("id").alias("__u"), F.regexp_replace("project", r"\\", "/").alias("__p")).distinct()
    return constraints.join(own, (F.upper("id") == F.col("__u")) & (F.col("project") == F.col("__p")), "left_anti")


def align(chosen: DataFrame, families: DataFrame, options: DataFrame) -> DataFrame:
    """chosen (id, version) with (leader): a family's members take its highest version; those that never had it keep theirs.

    Of members with the highest version the first by id leads. Packages without a family are not brought together.
    """
    family = families.select(F.upper("id").alias("__u"), "family").filter("family IS NOT NULL").dropDuplicates(["__u"])
    rows = chosen.join(family, F.upper("id") == F.col("__u"), "left").drop("__u").checkpoint()
    key = version_key(F.col("version"))
    top = first_per_key(rows.filter("family IS NOT NULL"), ["family"], [key.desc(), F.upper("id")]).select(F.col("family").alias("__f"), F.col("version").alias("__top"), F.col("id").alias("leader"))
    has = options.select(F.upper("id").alias("__i"), version_key(F.col("version")).alias("__k")).distinct()
    led = rows.filter("family IS NOT NULL").join(top, F.col("family") == F.col("__f"))
    led = led.join(has, (F.upper("id") == F.col("__i")) & (version_key(F.col("__top")) == F.col("__k")), "left")
    moves = F.col("__k").isNotNull() & (version_key(F.col("version")) < version_key(F.col("__top")))
    missing = F.when(F.col("__k").isNull() & (version_key(F.col("version")) < version_key(F.col("__top"))), F.col("__top"))
    led = led.select("id", F.when(moves, F.col("__top")).otherwise(F.col("version")).alias("version"), "family", F.when(moves, F.col("leader")).alias("leader"), missing.alias("missing"))
    none = F.lit(None).cast("string")
    return led.unionByName(rows.filter("family IS NULL").select("id", "version", "family", none.alias("leader"), none.alias("missing")))


def choose(options: DataFrame, constraints: DataFrame, lowest: bool = True) -> DataFrame:
    """(id, version): the lowest or newest option within all ranges asked of its id."""
    bounds = constraints.select(F.upper("id").alias("__c"), version_range(F.col("range")).alias("__b")).distinct()
    keyed = options.select("id", "version").distinct().withColumn("__k", version_key(F.col("version")))
    held = keyed.join(bounds, F.upper("id") == F.col("__c"), "left").groupBy("id", "version", "__k").agg(F.bool_and(F.col("__b").isNull() | in_range(F.col("__k"), F.col("__b"))).alias("ok"))
    pick = F.min_by if lowest else F.max_by
    return held.filter("ok").groupBy("id").agg(pick("version", "__k").alias("version"))


def deciding(constraints: DataFrame, chosen: DataFrame) -> DataFrame:
    """(CONSTRAINT): for each choice the highest lower bound not above it; of equal ones by kind, then project, then range."""
    rows = constraints.join(chosen.select(F.upper("id").alias("__i"), version_key(F.col("version")).alias("__v")), F.upper("id") == F.col("__i"))
    rows = rows.withColumn("__low", low_key(F.col("range"))).filter("__low <= __v")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return first_per_key(rows, ["id"], [F.desc("__low"), rank, F.coalesce("project", F.lit("")), F.col("range"), F.col("chain")]).drop("__i", "__v", "__low")


def conflicts(constraints: DataFrame, chosen: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, code, project, range, chain) for each id without a choice.

    `pin conflict`: a pin for all that another constraint forbids, and of these the one with the highest lower bound;
    else `no version`, and the constraint with the highest lower bound (null if none has one).
    """
    open_ = ids.select("id").distinct().join(chosen.select(F.upper("id").alias("__c")), F.upper("id") == F.col("__c"), "left_anti")
    asked = constraints.join(open_.select(F.upper("id").alias("__o")), F.upper("id") == F.col("__o"), "left_semi").withColumn("low", low_key(F.col("range")))
    pin = asked.filter("kind = 'pin'").select(F.upper("id").alias("__p"), version_range(F.col("range"))["low"].alias("to"))
    order = [F.desc_nulls_last("low"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.coalesce("project", F.lit("")), F.col("range"), F.col("chain")]
    barred = asked.filter("kind != 'pin'").join(pin, F.upper("id") == F.col("__p")).filter(~satisfies(F.col("to"), F.col("range")))
    barred = first_per_key(barred, ["id"], order).select(F.upper("id").alias("__b"), F.struct("project", "range", "chain").alias("bar"))
    floor = first_per_key(asked.filter("low IS NOT NULL"), ["id"], order).select(F.upper("id").alias("__l"), F.struct("project", "range", "chain").alias("floor"))
    rows = open_.join(barred, F.upper("id") == F.col("__b"), "left").join(floor, F.upper("id") == F.col("__l"), "left")
    said = F.coalesce("bar", "floor")
    return rows.select("id", F.when(F.col("bar").isNotNull(), "pin conflict").otherwise("no version").alias("code"), said["project"].alias("project"), said["range"].alias("range"), said["chain"].alias("chain"))


def pin_report(pins: DataFrame, transitive: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, project, pin, standing, version, chain) of project pins that need a word.

    `conflict`: the project's own packages ask for a range without the pin (the one with the highest lower bound);
    else `below`: the others move to a higher version.
    """
    own = pins.filter("project IS NOT NULL").filter(version_key(F.col("version")).isNotNull()).select(F.col("id").alias("__id"), F.regexp_replace("project", r"\\", "/").alias("__project"), F.col("version").alias("pin")).distinct()
    asked = transitive.select("id", F.col("project").alias("__p"), "range", F.col("chain").alias("__chain"))
    bad = own.join(asked, (F.upper("__id") == F.upper("id")) & (F.col("__project") == F.col("__p"))).filter(~satisfies(F.col("pin"), F.col("range")))
    bad = first_per_key(bad, ["__id", "__project", "pin"], [low_key(F.col("range")).desc_nulls_last(), F.col("range"), F.col("__chain")]).select(F.col("__id").alias("__a"), F.col("__project").alias("__b"), F.col("pin").alias("__c"), F.col("__chain").alias("chain"))
    rows = own.join(bad, (F.col("__id") == F.col("__a")) & (F.col("__project") == F.col("__b")) & (F.col("pin") == F.col("__c")), "left")
    rows = rows.join(chosen.select(F.upper("id").alias("__u"), F.col("id").alias("spelt"), F.col("version").alias("to")), F.upper("__id") == F.col("__u"), "left")
    standing = F.when(F.col("chain").isNotNull(), "conflict").when(version_key(F.col("pin")) < version_key(F.col("to")), "below")
    return rows.select(F.coalesce("spelt", "__id").alias("id"), F.col("__project").alias("project"), "pin", standing.alias("standing"), F.col("to").alias("version"), "chain").filter("standing IS NOT NULL")


@dataclass
class Settled:
    """chosen (id, version, family, leader, missing), the constraints of the last round, and the rounds it took."""

    chosen: DataFrame
    constraints: DataFrame
    rounds: int


def settle(base: DataFrame, options: DataFrame, dependencies: DataFrame, families: DataFrame | None = None, pins: DataFrame | None = None, lowest: bool = True, ids: DataFrame | None = None) -> Settled:
    """The choice for ids (default: those of base) under base, their direct and transitive constraints (id, project, kind, range, chain).

    options (id, version), dependencies (id, version, dep_id, range): what a version asks of other packages. Choices that
    still change after MAX_ROUNDS raise.
    """
    checkpoint_ready(base.sparkSession)
    ids = (base if ids is None else ids).select("id").distinct().checkpoint()
    fixed = base.select(*CONSTRAINT)
    if pins is not None:
        fixed = without_pinned(fixed, pins).unionByName(global_pins(ids, pins))
    fixed = fixed.distinct().checkpoint()
    own = options.join(ids.select(F.upper("id").alias("__u")), F.upper("id") == F.col("__u"), "left_semi").select("id", "version").checkpoint()
    families = families if families is not None else ids.select("id", F.lit(None).cast("string").alias("family"))
    chosen = own.limit(0)
    for round_ in range(1, MAX_ROUNDS + 1):
        asked = fixed.unionByName(selected_constraints(ids, chosen, dependencies)).checkpoint()
        new = align(choose(own, asked, lowest), families, own).checkpoint()
        same = new.select("id", "version")
        if round_ > 1 and same.exceptAll(chosen.select("id", "version")).isEmpty() and chosen.select("id", "version").exceptAll(same).isEmpty():
            return Settled(new, asked, round_ - 1)
        chosen = new
    raise RuntimeError(f"versions still change after {MAX_ROUNDS} rounds")


def reasons(settled: Settled, lowest: bool = True) -> DataFrame:
    """(id, version, deciding, kind, reason): what decided each choice, in words; aligned members tell their leader's."""
    which = "The lowest version" if lowest else "The newest version"
    why = deciding(settled.constraints, settled.chosen).select(F.upper("id").alias("__d"), "kind", "project", "range", "chain")
    rows = settled.chosen.withColumn("__by", F.upper(F.coalesce("leader", "id"))).join(why, F.col("__by") == F.col("__d"), "left")
    chain = F.array_join("chain", " → ")
    because = F.when(F.col("kind").isin("direct", "pin") | F.col("project").isNull(), chain).otherwise(F.concat("project", F.lit(": "), chain))
    lead = settled.chosen.select(F.upper("id").alias("__l"), F.col("version").alias("led"))
    rows = rows.join(lead, F.col("__by") == F.col("__l"), "left")
    floor = version_range(F.col("range"))["low"]
    plain = F.when(F.col("kind").isNull(), F.lit(which + ".")).when(version_key(floor) == version_key(F.col("led")), F.concat(because, F.lit("."))).otherwise(F.concat(F.lit(which + " from "), normal(floor), F.lit(" ("), because, F.lit(").")))
    reason = F.when(F.col("leader").isNull(), plain).otherwise(F.concat(F.lit("Aligned with the "), "family", F.lit(" family at "), normal(F.col("version")), F.lit(", which "), "leader", F.lit(" needs: "), plain))
    return rows.select("id", "version", "chain", "kind", reason.alias("reason"))
