"""Writers: canonical JSON lines, packages with a manifest, immutable releases.

Spark's commit protocol makes each write appear at once or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields that each training target delivers.
FIELDS = {
    "cpt": ["text"], "sft": ["messages", "tools"], "multiturn": ["messages", "tools"], "agent": ["messages", "tools"],
    "dpo": ["prompt", "chosen", "rejected", "tools"], "orpo": ["prompt", "chosen", "rejected", "tools"],
    "rlaif": ["prompt", "responses", "criterion"], "gsm8k": ["question", "answer"], "cot": ["question", "reasoning", "answer"],
}


def canonical(df: DataFrame) -> DataFrame:
    """value: each row as JSON with sorted keys."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, sha256 of the sum of row digests): independent of order and partitioning."""
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    row = canonical(df).select(F.sha2("value", 256).alias("h")).agg(
        F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*"), *[F.coalesce(part(i), F.lit(0)).cast("string") for i in range(4)]), 256).alias("d")
    ).first()
    return row["n"], row["d"]


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    canonical(df).write.mode(mode).text(path)


def training_records(df: DataFrame, target: str) -> DataFrame:
    """The delivered columns of a target alone."""
    return df.select(*[c for c in FIELDS[target] if c in df.columns])


def write_package(rows: dict[str, DataFrame], path: str) -> None:
    """<path>/<target>/data, audit and quality, and one manifest with counts and digests.

    Rows have status and reason beside their target's fields; eligible ones are delivered.
    """
    spark = next(iter(rows.values())).sparkSession
    manifest = []
    for target, df in rows.items():
        out = training_records(df.filter("status = 'eligible'"), target)
        write_jsonl(out, f"{path}/{target}/data")
        write_jsonl(df, f"{path}/{target}/audit")
        write_jsonl(df.groupBy("status", "reason").agg(F.count("*").alias("n")), f"{path}/{target}/quality")
        manifest.append((target, *digest(out)))
    write_jsonl(spark.createDataFrame(manifest, "target string, rows bigint, sha256 string"), f"{path}/manifest")


def release(df: DataFrame, path: str, tag: str, expected: str | None = None) -> None:
    """An immutable tag: fails if it exists or if the source is not the expected one."""
    n, found = digest(df)
    if expected is not None and expected != found:
        raise ValueError("the source changed since it was reviewed")
    write_jsonl(df, f"{path}/{tag}/data")
    name = df.sparkSession.createDataFrame([(tag, n, found)], "name string, rows bigint, sha256 string")
    write_jsonl(name, f"{path}/{tag}/manifest")
