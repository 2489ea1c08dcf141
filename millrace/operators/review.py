"""Review ledgers: queues, consensus, current state, sampling and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SAMPLES, MIN_KEEP, MIN_COVERAGE = 10, 0.9, 0.9


def pending(records: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Records without a response."""
    return records.join(responses.select(key), key, "left_anti")


def reviewed(records: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    return records.join(responses.select(key), key, "left_semi")


def with_decision(records: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """``records`` with decision, pending where there is none."""
    return records.join(responses.select(key, "decision"), key, "left").withColumn(
        "decision", F.coalesce("decision", F.lit("pending"))
    )


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One page of a stable order: a limit is what this asks for."""
    return rows.orderBy(*order).offset(offset).limit(size)


def bound(records: DataFrame, votes: DataFrame, key: str, digest: str) -> DataFrame:
    """Votes that were cast on the present content of their record."""
    return votes.join(records.select(key, digest), [key, digest])


def consensus(votes: DataFrame, key: str) -> DataFrame:
    """key, votes, outcome: keep or reject where all agree, else conflict."""
    return votes.groupBy(key).agg(
        F.count("*").alias("votes"),
        F.when(F.min("decision") == F.max("decision"), F.min("decision")).otherwise("conflict").alias("outcome"),
    )


def gate(outcomes: DataFrame) -> DataFrame:
    """reviewed, kept, conflicts, pass_rate, release of the consensus table."""
    of = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    n, k = F.count("*"), of("keep")
    rate = F.try_divide(k, n)
    return outcomes.agg(
        n.alias("reviewed"), k.alias("kept"), of("conflict").alias("conflicts"), F.round(rate, 3).alias("pass_rate"),
        ((n >= MIN_SAMPLES) & (F.coalesce(rate, F.lit(0.0)) >= MIN_KEEP)).alias("release"),
    )


def latest(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last event of every key; a maximum, so a hot key is reduced map-side."""
    rest = [c for c in events.columns if c != key]
    top = F.max_by(F.struct(*rest), sequence).alias("top")
    return events.groupBy(key).agg(top).select(key, "top.*")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side of what only one of both has."""
    x = a.select(key).distinct().withColumn("x", F.lit(1))
    y = b.select(key).distinct().withColumn("y", F.lit(1))
    both = x.join(y, key, "full_outer").filter("x IS NULL OR y IS NULL")
    return both.select(key, F.when(F.col("y").isNull(), "left").otherwise("right").alias("side"))


def running(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of its group that come before; a name
    in ``order`` that starts with a minus sign descends.

    A range partitioning by group and order, and one sum for each group of each
    partition: a group that holds much of the table is spread over many tasks.
    """
    from millrace.operators.storage import stored

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    placed = stored(rows.withColumn("_value", value).repartitionByRange(n, F.col(by).asc(), *keys).withColumn("_part", F.spark_partition_id()))
    past = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(by, "_part").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_part", by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    both = own.join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return both.withColumn(name, (F.col("_own") + F.col("_off")).cast("long")).select(*rows.columns, name)


def positions(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with position in their queue, from 0."""
    return running(rows, by, [order], F.lit(1), "position")


def revisions(rows: DataFrame, base: Column, order: str) -> DataFrame:
    """``rows`` with revision: <base>-rN in order of arrival."""
    placed = running(rows.withColumn("_base", base), "_base", [order], F.lit(1), "_n")
    return placed.withColumn("revision", F.concat("_base", F.lit("-r"), (F.col("_n") + 1).cast("string"))).drop("_base", "_n")


def stable_sample(rows: DataFrame, by: str, key: Column, percent: float, cap: int) -> DataFrame:
    """The least hashes of each group: min(n, cap, ceil(n * percent / 100)) rows, the same on every run."""
    sizes = rows.groupBy(F.col(by).alias("_g")).agg(F.least(F.lit(cap), F.ceil(F.count("*") * percent / 100)).alias("_size"))
    placed = running(rows.withColumn("_rank", F.sha2(key, 256)), by, ["_rank"], F.lit(1), "_at")
    return placed.join(sizes, F.col(by).eqNullSafe(F.col("_g"))).filter("_at < _size").select(*rows.columns)


def escalate(outcomes: DataFrame, by: str, failed: Column, percent: float) -> DataFrame:
    """by, sampled, failed, full_review: whether a sample's failures reach the threshold."""
    return outcomes.groupBy(by).agg(F.count("*").alias("sampled"), F.count(F.when(failed, 1)).alias("failed")).withColumn(
        "full_review", F.col("failed") * 100 >= F.col("sampled") * percent
    )


def release_report(rows: DataFrame, by: str, key: str, content: str) -> DataFrame:
    """by, rows, duplicate_content, duplicate_ids, length statistics of a release."""
    per = rows.groupBy(by, F.sha2(content, 256).alias("digest")).agg(
        F.count("*").alias("n"), F.min(F.length(content)).alias("least"), F.max(F.length(content)).alias("most"),
        F.sum(F.length(content)).alias("chars"),
    )
    ids = rows.groupBy(by, key).agg((F.count("*") - 1).alias("extra")).groupBy(by).agg(F.sum("extra").alias("duplicate_ids"))
    out = per.groupBy(by).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_content"), F.min("least").alias("min_chars"),
        F.max("most").alias("max_chars"), (F.sum("chars") / F.sum("n")).alias("mean_chars"),
    )
    return out.join(ids, by)


def island_stops(rounds: DataFrame, by: str, order: str, low: Column, limit: int) -> DataFrame:
    """by, order, run: lengths of consecutive low rounds; ``stop`` where one reaches the limit."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rounds.withColumns({"_low": low, "_island": F.sum(F.when(low, 0).otherwise(1)).over(w)})
    inside = Window.partitionBy(by, "_island").orderBy(order)
    run = F.sum(F.when(F.col("_low"), 1).otherwise(0)).over(inside)
    return marked.withColumn("run", run).withColumn("stop", F.col("run") >= limit).drop("_low", "_island")


def merge(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The next snapshot: a new row replaces the old one of its key, other old rows stay."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    both = old.join(n, key, "full_outer")
    return both.select(key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def global_positions(rows: DataFrame, order: str, partitions: int = 0) -> DataFrame:
    """``rows`` with position in the order of the whole table, from 0.

    A range partitioning and the sizes of its partitions (one number each), so
    no task sees all rows.
    """
    from millrace.operators.storage import stored

    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    sizes, before = {}, 0
    for r in sorted(placed.groupBy("_part").count().collect()):
        sizes[r["_part"]], before = before, before + r["count"]
    first = F.create_map(*[F.lit(int(x)) for kv in sizes.items() for x in kv]) if sizes else F.create_map(F.lit(0), F.lit(0))
    w = Window.partitionBy("_part").orderBy(order)
    return placed.withColumn("position", (first[F.col("_part")] + F.row_number().over(w) - 1).cast("long")).drop("_part")


def round_robin(ready: DataFrame, order: str, count: int) -> DataFrame:
    """``ready`` rows repeated in order until there are ``count`` candidates: row p serves p, p + n, p + 2n, ..."""
    placed = global_positions(ready, order)
    n = ready.count()
    serves = F.sequence(F.col("position"), F.lit(count - 1), F.lit(max(n, 1)))
    return placed.filter(F.col("position") < count).select("*", F.explode(serves).alias("candidate")).drop("position")
