"""Generated arithmetic whose answers are known by construction, and its verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import udfs

# The registry's permutation of seeds.
MODULUS, STEP = 4 * 97 * 89 * 83, 65_537


def seeds(df: DataFrame, position: str = "position") -> DataFrame:
    """``df`` with seed: a permutation of positions, so resumed runs meet no seed twice."""
    return df.withColumn("seed", (F.col(position) * STEP) % MODULUS)


def _n(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def _by_family(seed: Column, parts: list[Column]) -> Column:
    return F.element_at(F.array(*parts), (seed % 4).cast("int") + 1)


def one_step(seed: Column) -> tuple[Column, Column]:
    """(expression, result) of four one-step families."""
    a, b = seed % 17 + 2, F.floor(seed / 17) % 17 + 2
    write = lambda x, sign: F.concat(_n(x), F.lit(f" {sign} "), _n(b))
    text = _by_family(seed, [write(a, "+"), write(a, "*"), write(a + b, "-"), write(a * b, "//")])
    return text, _by_family(seed, [a + b, a * b, a, a]).cast("bigint")


def several_steps(seed: Column) -> tuple[Column, Column]:
    """(array<struct<expression,result>> of the steps, result) of four families of two or three steps.

    What is taken away never uses up all there is."""
    a, b, c = seed % 97 + 2, F.floor(seed / 97) % 89 + 2, F.floor(seed / 8633) % 83 + 1
    less = F.least(c, a * b - 1)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else _n(p) for p in parts])
    step = lambda text, value: F.struct(text.alias("expression"), value.cast("bigint").alias("result"))
    groups = step(join(a, " * ", b), a * b)
    steps = _by_family(seed, [
        F.array(groups, step(join(a, " * ", b, " + ", c), a * b + c)),
        F.array(groups, step(join(a, " * ", b, " - ", less), a * b - less)),
        F.array(step(join(a, " + ", b), a + b), step(join("(", a, " + ", b, ") * ", c), (a + b) * c)),
        F.array(groups, step(join(a, " * ", b, " + ", c, " * ", b), (a + c) * b), step(join("(", a, " * ", b, " + ", c, " * ", b, ") // ", b), a + c)),
    ])
    return steps, F.element_at(steps, -1)["result"]


# The texts of an answer.
ONE_STEP_ANSWER = "列式：{0} = {1}。因此答案是 {1}。 <<{0}={1}>> #### {1}"
EXPLANATIONS = (
    ("先计算成组资料的总数", "再加上额外资料"),
    ("先计算准备的资料总数", "再减去已经使用的资料"),
    ("先计算每天上午与下午完成的总数", "再乘以工作的天数"),
    ("先计算原有资料总数", "再加上新增资料", "最后平均分组"),
)


def one_step_answer(expression: Column, result: Column) -> Column:
    parts = ONE_STEP_ANSWER.replace("{0}", "%1$s").replace("{1}", "%2$s")
    return F.format_string(parts, expression, result.cast("string"))


def several_steps_answer(seed: Column, steps: Column) -> Column:
    """One explained line for each step, then the terminal answer."""
    said = _by_family(seed, [F.array(*map(F.lit, x)) for x in EXPLANATIONS])
    lines = F.zip_with(said, steps, lambda e, s: F.concat(e, F.lit("：<<"), s["expression"], F.lit("="), s["result"].cast("string"), F.lit(">>。")))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n#### "), F.element_at(steps, -1)["result"].cast("string"))


def fingerprint(expression: Column) -> Column:
    """Identity of a calculation, whatever the order of the operands of + and *; null if it is invalid."""
    return F.sha2(F.concat(F.lit("arithmetic-expression-v1\0"), udfs.canonical_expression(expression)), 256)


def verified(rows: DataFrame, answer: str = "answer", expression: str | None = None) -> DataFrame:
    """``rows`` with issue: every <<expression=value>> recomputes, the one terminal answer is the last
    value, and the last calculation is that of ``expression``, if there is one."""
    pattern = F.lit(r"<<([^<>]+)=(-?[0-9]+)>>")
    texts, values = (F.regexp_extract_all(answer, pattern, F.lit(i)) for i in (1, 2))
    final = F.regexp_extract(answer, r"####\s*(-?[0-9]+)\s*$", 1)
    times = lambda x: F.regexp_count(answer, F.lit(x))
    df = rows.withColumns({"_e": texts, "_v": values, "_m": final})
    df = df.withColumn("_got", udfs.arithmetic_each(F.array_join("_e", ";")))
    matches = F.zip_with("_v", "_got", lambda v, g: F.coalesce(v.cast("bigint") == g, F.lit(False)))
    issue = (
        F.when(F.length(answer) > 16_000, "answer_too_long")
        .when((F.size("_v") == 0) | (times("<<") != F.size("_v")) | (times(">>") != F.size("_v")), "missing_steps")
        .when((F.col("_m") == "") | (times("####") != 1), "terminal_answer_count")
        .when(~F.forall(matches, lambda x: x), "step_mismatch")
        .when(F.try_element_at("_v", F.lit(-1)).cast("bigint") != F.col("_m").cast("bigint"), "answer_mismatch")
    )
    if expression:
        tree = udfs.expression_tree(F.try_element_at("_e", F.lit(-1)))
        df = df.withColumns({"_tree": udfs.expression_tree(F.col(expression)), "_last": tree})
        issue = issue.when(~F.col("_tree").eqNullSafe(F.col("_last")) | F.col("_tree").isNull(), "other_calculation")
    return df.withColumn("issue", issue).drop("_e", "_v", "_m", "_got", "_tree", "_last")


def unseen(rows: DataFrame, ledger: DataFrame, expression: str = "expression", order: str = "position") -> DataFrame:
    """``rows`` with fingerprint whose calculation neither ``ledger`` (fingerprint) nor an earlier row has."""
    named = rows.withColumn("fingerprint", fingerprint(F.col(expression))).filter("fingerprint IS NOT NULL")
    first = named.groupBy("fingerprint").agg(F.min(order).alias(order))
    return named.join(first, ["fingerprint", order]).join(ledger.select("fingerprint"), "fingerprint", "left_anti").select(named.columns)
