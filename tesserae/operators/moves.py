"""Which files of a project can move to another one, what they bring along, and why the others stay.

The search alternates between two fixed points: files that move bring what they need (co-moves), and files that can't
move keep back what needs them; what was only brought along for a file that stays, stays too. Reasons travel with the
fixed points: the turn in which a file drops out decides which of its needs is told. Rounds are joins over the files
concerned, cut off by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import gathered, plain, reached_set, reverse
from tesserae.operators.relational import first_per_key
from tesserae.session import checkpoint_ready

#: Why a file stays.
KEPT_BACK, PROJECT_CYCLE, USED_BY_STAYING, NOT_NEEDED = "needs a file that stays", "project cycle", "used by files that stay", "co-move not needed"


def paths_to(edges: DataFrame, goal, depth: int | None = None) -> DataFrame:
    """(node, path): for every node that reaches the goal, a shortest way there, both included; of several the least by names.

    Levels are walked back from the goal; a node goes on to the least of its neighbours on the level below, which gives
    the least of all shortest ways. The goal's own way is itself.
    """
    checkpoint_ready(edges.sparkSession)
    steps = plain(edges).checkpoint()
    kind = edges.schema["src"].dataType.simpleString()
    new = steps.limit(0).select("src", F.array("src").alias("path")).unionByName(edges.sparkSession.range(1).select(F.lit(goal).cast(kind).alias("src"), F.array(F.lit(goal).cast(kind)).alias("path"))).withColumnRenamed("src", "node").checkpoint()
    parts, level = [new], 0
    while not new.isEmpty() and (depth is None or level < depth):
        level += 1
        step = steps.join(new.select(F.col("node").alias("n"), "path"), F.col("dst") == F.col("n")).groupBy("src").agg(F.min_by("path", "dst").alias("path"))
        step = step.join(gathered(parts).select(F.col("node").alias("k")), F.col("src") == F.col("k"), "left_anti")
        new = step.select(F.col("src").alias("node"), F.concat(F.array("src"), "path").alias("path")).checkpoint()
        parts.append(new)
    return gathered(parts)


def project_blocks(uses: DataFrame, edges: DataFrame, source, destination, held: DataFrame, unfit: DataFrame | None = None) -> DataFrame:
    """(file, code, details): files that use a project which the destination can't refer to; the first such project is told.

    uses (file, project); held: a one-column frame of what the destination refers to already; unfit (project, reason):
    projects with nothing for the destination's targets. A project that depends on the destination closes a cycle, told
    by the way round from the destination and back.
    """
    other = uses.filter((F.col("project") != F.lit(source)) & (F.col("project") != F.lit(destination))).distinct()
    other = other.join(held.select(F.col(held.columns[0]).alias("h")), F.col("project") == F.col("h"), "left_anti")
    back = paths_to(edges, destination)
    rows = other.join(back, F.col("project") == F.col("node"), "left")
    cycle = F.when(F.col("path").isNotNull(), F.struct(F.lit(PROJECT_CYCLE).alias("code"), F.concat(F.array(F.lit(destination)), "path").alias("details")))
    if unfit is not None:
        rows = rows.join(unfit.select(F.col("project").alias("u"), "reason"), F.col("project") == F.col("u"), "left")
        cycle = F.coalesce(cycle, F.when(F.col("reason").isNotNull(), F.struct(F.col("reason").alias("code"), F.array("project").alias("details"))))
    rows = rows.withColumn("x", cycle).filter("x IS NOT NULL")
    return first_per_key(rows, ["file"], [F.col("project")]).select("file", "x.code", "x.details")


def brought(requested: DataFrame, pulls: DataFrame, together: DataFrame) -> DataFrame:
    """(file, turn, via): all that requested files bring, the turn in which each comes, and the file it comes for.

    pulls (src, dst) count a turn; together (src, dst), files that only move as one, come in the same turn. In a turn
    files come for the least by name that brings them.
    """
    new = requested.select(F.col(requested.columns[0]).alias("file")).distinct().select("file", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("via")).checkpoint()
    parts, turn = [new], 0
    side = together.filter("src != dst").select("src", "dst").distinct()
    step = pulls.filter("src != dst").select("src", "dst").distinct()
    while True:
        close = new
        while not close.isEmpty():  # what only moves together
            more = close.join(side, F.col("file") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("src").alias("via"))
            close = more.join(gathered(parts).select(F.col("file").alias("k")), F.col("to") == F.col("k"), "left_anti").select(F.col("to").alias("file"), F.lit(turn).alias("turn"), "via").checkpoint()
            parts.append(close)
        turn += 1
        last = gathered(parts).filter(F.col("turn") == turn - 1)
        more = last.join(step, F.col("file") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("src").alias("via"))
        new = more.join(gathered(parts).select(F.col("file").alias("k")), F.col("to") == F.col("k"), "left_anti").select(F.col("to").alias("file"), F.lit(turn).alias("turn"), "via").checkpoint()
        if new.isEmpty():
            return gathered(parts)
        parts.append(new)


def kept_back(candidates: DataFrame, needs: DataFrame, stuck: DataFrame) -> DataFrame:
    """(file, turn, code, details): candidates that can't move, because they are stuck or need one that can't.

    candidates (file, turn), needs (src, dst), stuck (file, code, details): also of files that are no candidates. Files
    are looked at in turns, in each by name: a need that has dropped out before keeps a file back in that turn, one that
    drops out later in the turn after it. The first need by name that was out by then is told.
    """
    begins = candidates.select(F.col("file").alias("f"), (F.col("turn") + 1).alias("from"))
    reasons = stuck.dropDuplicates(["file"])
    own = reasons.join(begins, F.col("file") == F.col("f"), "left")
    # what is no candidate was out from the beginning
    state = own.select("file", F.coalesce("from", F.lit(0)).alias("turn")).checkpoint()
    steps = needs.filter("src != dst").select("src", "dst").distinct().join(begins, F.col("src") == F.col("f")).select("src", "dst", "from").checkpoint()
    new = state
    while not new.isEmpty():
        late = F.greatest("from", F.col("turn") + F.when((F.col("dst") < F.col("src")) | (F.col("turn") == 0), 0).otherwise(1))
        sent = steps.join(new, F.col("dst") == F.col("file")).select(F.col("src").alias("to"), late.alias("then")).groupBy("to").agg(F.min("then").alias("then"))
        known = state.select(F.col("file").alias("k"), F.col("turn").alias("old"))
        new = sent.join(known, F.col("to") == F.col("k"), "left").filter("old IS NULL OR then < old").select(F.col("to").alias("file"), F.col("then").alias("turn")).checkpoint()
        state = state.unionByName(new).groupBy("file").agg(F.min("turn").alias("turn")).checkpoint()
    out = state.join(begins, F.col("file") == F.col("f")).select("file", "turn", "from")
    gone = state.select(F.col("file").alias("g"), F.col("turn").alias("at"))
    first = out.join(needs.filter("src != dst").select("src", "dst").distinct(), F.col("file") == F.col("src")).join(gone, F.col("dst") == F.col("g"))
    first = first.filter((F.col("at") < F.col("turn")) | ((F.col("at") == F.col("turn")) & (F.col("dst") < F.col("file"))))
    first = first.groupBy(F.col("file").alias("w")).agg(F.min("dst").alias("need"))
    rows = out.join(reasons.select(F.col("file").alias("r"), "code", "details"), F.col("file") == F.col("r"), "left").join(first, F.col("file") == F.col("w"), "left")
    through = F.col("need").isNotNull()
    return rows.select("file", "turn", F.when(through, KEPT_BACK).otherwise(F.col("code")).alias("code"), F.when(through, F.array("need")).otherwise(F.col("details")).alias("details"))


def move_plan(requested: DataFrame, needs: DataFrame, together: DataFrame, stuck: DataFrame, co_move: bool = True, above: bool = False) -> tuple[DataFrame, DataFrame]:
    """(moves, stays): (file, co_move_of) of what moves, and (file, code, details) of what was looked at and stays.

    requested: a one-column frame; needs (src, dst): a file uses what another declares; together (src, dst): resource
    pairs and parts of one type; stuck (file, code, details): files that can't move by themselves (`project_blocks` and
    other rules; the first of several is the caller's choice). Without co_move, files that need one that was not
    requested stay. above: the destination uses the source, so that moved files may use what stays, but nothing that
    stays may use a moved file.
    """
    checkpoint_ready(requested.sparkSession)
    needs = needs.filter("src != dst").select("src", "dst").distinct().checkpoint()
    nothing = needs.limit(0)
    candidates = brought(requested, nothing if above or not co_move else needs, together).checkpoint()
    files = candidates.select(F.col("file").alias("c"))
    if above:
        outside = needs.join(files, F.col("src") == F.col("c"), "left_anti").select("src").unionByName(stuck.select(F.col("file").alias("src"))).distinct()
        inner = needs.join(files, F.col("dst") == F.col("c"), "left_semi")
        left = reached_set(inner, outside).select(F.col("node").alias("file"))
        own = stuck.dropDuplicates(["file"]).join(files, F.col("file") == F.col("c"), "left_semi").select("file", "code", "details")
        users = inner.join(left.select(F.col("file").alias("l")), F.col("src") == F.col("l"), "left_semi").groupBy(F.col("dst").alias("u")).agg(F.array_sort(F.collect_set("src")).alias("details"))
        used = left.join(users, F.col("file") == F.col("u")).join(own.select(F.col("file").alias("o")), F.col("file") == F.col("o"), "left_anti")
        back = own.unionByName(used.select("file", F.lit(USED_BY_STAYING).alias("code"), "details")).checkpoint()
    else:
        if not co_move:
            other = needs.join(files, F.col("dst") == F.col("c"), "left_anti").select(F.col("dst").alias("file")).distinct()
            stuck = stuck.unionByName(other.join(stuck.select(F.col("file").alias("s")), F.col("file") == F.col("s"), "left_anti").select("file", F.lit(KEPT_BACK).alias("code"), F.array().cast("array<string>").alias("details")))
        back = kept_back(candidates, needs.unionByName(together.select("src", "dst")), stuck).select("file", "code", "details").checkpoint()
    kept = candidates.join(back.select(F.col("file").alias("b")), F.col("file") == F.col("b"), "left_anti").checkpoint()
    live = kept.select(F.col("file").alias("x"))
    pulls = (nothing if above else needs).unionByName(together.select("src", "dst"))
    pulls = pulls.join(live, F.col("src") == F.col("x"), "left_semi").join(live, F.col("dst") == F.col("x"), "left_semi").checkpoint()
    asked = kept.join(requested.select(F.col(requested.columns[0]).alias("q")).distinct(), F.col("file") == F.col("q"), "left_semi")
    reached = brought(asked.select("file"), pulls, nothing).checkpoint()
    seen = reached.select(F.col("file").alias("s"), F.col("via").alias("now"))
    whose = kept.join(seen, F.col("file") == F.col("s"))
    still = seen.select(F.col("s").alias("still"))
    moves = whose.join(still, F.col("via") == F.col("still"), "left").select("file", F.when(F.col("now").isNull(), F.lit(None)).when(F.col("still").isNotNull(), F.col("via")).otherwise(F.col("now")).alias("co_move_of"))
    dropped = kept.join(seen, F.col("file") == F.col("s"), "left_anti").select("file", F.lit(NOT_NEEDED).alias("code"), F.when(F.col("via").isNull(), F.array().cast("array<string>")).otherwise(F.array("via")).alias("details"))
    return moves, back.unionByName(dropped)
