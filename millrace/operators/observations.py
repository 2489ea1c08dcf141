"""States that actions move, by a table: an action counts only where it finds the state it expects.

A key's actions are folded in order.  A step is a function from states to states, and
functions compose: blocks of ``BLOCK`` actions are folded from every state at once, then the
blocks of a key one after another, so a key with a third of all actions is no
single task's work.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions folded at once.
BLOCK = 1_000

# What each action does to an observation, and to a gate, by the state that it finds.
OBSERVATIONS = {
    ("pending", "claim"): "claimed",
    ("claimed", "bind"): "claimed",
    ("needs_attention", "bind"): "claimed",
    ("claimed", "propose"): "proposed",
    ("claimed", "no_update"): "no_update",
    ("needs_attention", "no_update"): "no_update",
    ("claimed", "fail"): "needs_attention",
    ("claimed", "release"): "pending",
    ("needs_attention", "release"): "pending",
}
GATES = {(s, a): t for s in ("pending", "awaiting", "approved", "rejected") for a, t in (("propose", "awaiting"), ("approve", "approved"), ("reject", "rejected"))}

Table = Mapping[tuple[str, str], str]


def _states(table: Table) -> list[str]:
    return sorted({s for s, _ in table} | set(table.values()))


def _stepped(table: Table, acc: Column, action: Column) -> Column:
    """(state, accepted, refused) after one more action."""
    moves = F.create_map(*(F.lit(x) for (s, a), t in table.items() for x in (f"{s}\0{a}", t)))
    to = F.try_element_at(moves, F.concat_ws("\0", acc["state"], F.coalesce(action, F.lit(""))))
    return F.struct(
        F.coalesce(to, acc["state"]).alias("state"),
        (acc["accepted"] + F.when(to.isNull(), 0).otherwise(1)).cast("bigint").alias("accepted"),
        (acc["refused"] + F.when(to.isNull(), 1).otherwise(0)).cast("bigint").alias("refused"),
    )


def folded(actions: DataFrame, table: Table, keys: list[str], order: str, action: str = "action", start: str = "pending") -> DataFrame:
    """keys, state, accepted, refused: where each key ends when its actions run by ``order`` (ties by
    action), each only where the table lets it.  A null or unknown action is refused."""
    zero = F.lit(0).cast("bigint")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order, action)) - 1
    placed = actions.select(*keys, order, action, F.floor(at / BLOCK).alias("_block"))
    blocks = placed.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(order, action))).alias("_run"))
    ends = [
        F.aggregate("_run", F.struct(F.lit(s).alias("state"), zero.alias("accepted"), zero.alias("refused")), lambda acc, x: _stepped(table, acc, x[action]))
        for s in _states(table)
    ]
    functions = blocks.select(*keys, "_block", F.map_from_arrays(F.array(*map(F.lit, _states(table))), F.array(*ends)).alias("_f"))
    per = functions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", F.map_entries("_f").alias("f")))).alias("_fs"))

    def then(acc: Column, x: Column) -> Column:
        to = F.element_at(F.filter(x["f"], lambda e: e["key"] == acc["state"]), 1)["value"]
        return F.struct(to["state"].alias("state"), (acc["accepted"] + to["accepted"]).alias("accepted"), (acc["refused"] + to["refused"]).alias("refused"))

    first = F.struct(F.lit(start).alias("state"), zero.alias("accepted"), zero.alias("refused"))
    return per.select(*keys, F.aggregate("_fs", first, then).alias("_end")).select(*keys, "_end.*")


def progress(observations: DataFrame, scope: str, state: str = "state", outcome: str = "outcome") -> DataFrame:
    """scope, state, outcome, count, total (of the scope)."""
    counts = observations.groupBy(scope, state, outcome).agg(F.count("*").alias("count"))
    return counts.withColumn("total", F.sum("count").over(Window.partitionBy(scope)))


def claimable(pending: DataFrame, scope: str, order: str, chars: str, max_records: int, max_chars: int) -> DataFrame:
    """scope, order, status of the next batch of each scope: the first pending records, as many as
    ``max_records`` and as ``max_chars`` hold when they are written as one JSON array.

    The record that is first and too large by itself comes alone, with status needs_capacity; others are claimed.
    Records beyond ``max_records`` are left before lengths are summed, so no scope is scanned in one task
    beyond the ranking's own first rows.
    """
    w = Window.partitionBy(scope).orderBy(order)
    first = pending.select(scope, order, chars).withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= max_records)
    needed = F.lit(1) + F.sum(F.col(chars) + 1).over(w)  # brackets, and a comma between two
    sized = first.withColumn("_needed", needed)
    status = F.when(F.col("_needed") <= max_chars, "claimed").when(F.col("_at") == 1, "needs_capacity")
    return sized.select(scope, order, status.alias("status"), F.col("_needed").alias("characters")).filter("status IS NOT NULL")


def gates(definitions: Mapping[str, bool], events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, gate, status, blocked for every gate of ``definitions`` (whether it approves itself; a small table
    of settings) and every key that has events.

    ``events``: keys, gate, action (propose, approve, reject) and ``order``.  A gate that approves itself is
    approved whatever is decided; events of unknown gates count for none (``unknown_gates`` lists them).
    """
    ends = folded(events.filter(F.col("gate").isin(*definitions)), GATES, [*keys, "gate"], order)
    gate = F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(a).alias("auto")) for g, a in definitions.items())))
    every = events.select(*keys).distinct().withColumn("_g", gate).select(*keys, "_g.*")
    status = F.when(F.col("auto"), "approved").otherwise(F.coalesce("state", F.lit("pending")))
    out = every.join(ends, [*keys, "gate"], "left").withColumn("status", status)
    return out.select(*keys, "gate", "status", (F.col("status") != "approved").alias("blocked"))


def unknown_gates(definitions: Mapping[str, bool], events: DataFrame) -> DataFrame:
    """The decisions on gates that are not defined; a proposal may name any gate."""
    return events.filter((F.col("action") != "propose") & ~F.col("gate").isin(*definitions))
