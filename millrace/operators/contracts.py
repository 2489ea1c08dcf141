"""Row contracts: the reason a record fails, or null.  First failing rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

MAX_CORPUS_CHARS, MAX_CLEANED_CHARS, MAX_CONTEXT_CHARS = 500_000, 80_000, 80_000
SCORES = ("correctness", "reasoning", "grounding", "instruction", "safety")
FLAGS = ("source_faithful", "numbers_and_units_preserved", "formulas_and_code_preserved", "coverage_sufficient")
VERDICT = (
    "struct<keep:boolean,grounded:boolean,reasoning_valid:boolean,correctness:int,reason:string,"
    f"scores:struct<{','.join(f'{s}:int' for s in SCORES)}>>"
)


def corpus_row(text: Column) -> Column:
    return F.when(text.isNull() | (T.strip(text) == ""), "empty_cpt_record").when(F.length(text) > MAX_CORPUS_CHARS, "cpt_record_too_long")


def cleaned(text: Column, uncertain: Column, noise: Column, reason: Column) -> Column:
    """The contract of a cleaning step's answer."""
    bad_noise = F.exists(noise, lambda x: x.isNull() | (T.strip(x) == "") | (F.length(x) > 300))
    ok = (
        text.isNotNull() & (F.length(text) <= MAX_CLEANED_CHARS) & uncertain.isNotNull() & noise.isNotNull()
        & (F.size(noise) <= 20) & ~bad_noise & (T.strip(reason) != "") & (F.length(reason) <= 2_000)
    )
    return F.when(~F.coalesce(ok, F.lit(False)), "invalid_cpt_clean_schema")


def preserved(flags: Column) -> Column:
    """Whether all four preservation flags of a struct hold; null where one is missing."""
    out = F.lit(True)
    for f in FLAGS:
        out = out & flags[f]
    return out


def verdict(v: Column) -> Column:
    """The contract of a judge's verdict (a struct as in VERDICT)."""
    within = lambda x: F.coalesce(x.between(1, 5), F.lit(False))
    bools = v["keep"].isNull() | v["grounded"].isNull() | v["reasoning_valid"].isNull()
    scores = F.lit(True)
    for s in SCORES:
        scores = scores & within(v["scores"][s])
    return (
        F.when(v.isNull(), "invalid_judge_schema").when(bools, "invalid_judge_boolean").when(~within(v["correctness"]), "invalid_judge_score")
        .when(T.strip(F.coalesce(v["reason"], F.lit(""))) == "", "missing_judge_reason").when(~scores, "invalid_jev_dimensions")
    )


def accepted(v: Column) -> Column:
    out = v["keep"] & v["grounded"] & v["reasoning_valid"] & (v["correctness"] >= 4)
    for s in SCORES:
        out = out & (v["scores"][s] >= 4)
    return F.coalesce(out, F.lit(False))


def judge_suggestion(score: Column) -> Column:
    """keep, reject or null from a judge's JSON or loose text."""
    text = T.strip(F.coalesce(score, F.lit("")))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    flag = F.lit(None).cast("string")
    for name in ("valid", "pass", "keep"):
        has = F.get_json_object(text, f"$.{name}")
        value = F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == "BOOLEAN", has)
        flag = F.when(has.isNotNull(), F.coalesce(value, F.lit("none"))).otherwise(flag)
    word = F.rtrim(F.regexp_replace(F.rtrim(F.regexp_replace(F.lower(text), r"\}+$", "")), ",$", ""))
    loose = F.when(word.endswith("true") | word.isin("keep", "1"), "keep").when(word.endswith("false") | word.isin("reject", "0"), "reject")
    as_word = lambda c: F.when(c == "true", "keep").when(c == "false", "reject")
    return (
        F.when(text == "", None).when(parsed.isNull() | (kind == "STRING"), loose).when(kind == "BOOLEAN", as_word(text))
        .when(kind.startswith("OBJECT"), as_word(flag))
    )


def error_flag(a: Column, b: Column) -> Column:
    """struct<error,issue> of a message's two recorded flags."""
    return F.struct(
        F.when(a == ~b, F.lit(False)).otherwise(F.coalesce(a, b, F.lit(False))).alias("error"),
        F.when(a == ~b, "invalid_tool_error_flag").alias("issue"),
    )


def reasoning_alias(message: Column, names: tuple[str, ...] = ("reasoning_content", "reasoning", "thinking")) -> Column:
    """The one reasoning text of a message whose aliases agree; null if they disagree or there is none."""
    said = F.array_distinct(F.filter(F.array(*[message[n] for n in names]), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.when(F.size(said) == 1, F.get(said, F.lit(0)))


def normalised_roles(messages: Column) -> Column:
    """array<struct<role,content>> of records that say from/value, human/gpt/observation."""
    names = F.create_map(*[F.lit(x) for kv in {"human": "user", "gpt": "assistant", "observation": "tool"}.items() for x in kv])

    def one(m: Column) -> Column:
        role = F.coalesce(m["role"], m["from"])
        return F.struct(F.coalesce(names[role], role).alias("role"), F.coalesce(m["content"], m["value"], F.lit("")).alias("content"))

    return F.transform(messages, one)


def import_counts(turns: DataFrame) -> DataFrame:
    """conv_id, counts per role and which targets a conversation can serve."""
    of = lambda r: F.count(F.when(F.col("role") == r, 1))
    df = turns.groupBy("conv_id").agg(
        F.count("*").alias("messages"), of("user").alias("users"), of("assistant").alias("assistants"), of("system").alias("systems"),
        of("tool").alias("tools"), F.max_by("role", "turn").alias("last"),
    )
    ok = (F.col("users") > 0) & (F.col("last") == "assistant")
    return df.withColumns({"sft": ok, "multiturn": ok & (F.col("assistants") >= 2), "agent": ok & (F.col("tools") > 0)}).drop("last")


def ordered_subset(staged: DataFrame, source: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """One row: whether staged rows are an unchanged subsequence of the source rows.

    Each staged row must be in the source with its digest, and the places must
    rise; neighbours are compared in a window over (key's) place buckets, whose
    ends meet in one minimum and maximum each.
    """
    both = staged.select(key, F.col(digest).alias("sd"), F.col(order).alias("so")).join(
        source.select(key, digest, F.col(order).alias("at")), key, "left"
    )
    bucket = F.floor(F.col("so") / 10_000)
    from pyspark.sql import Window

    w = Window.partitionBy("b").orderBy("so")
    inside = both.withColumn("b", bucket).withColumn("back", F.coalesce(F.col("at") <= F.lag("at").over(w), F.lit(False)))
    per = inside.groupBy("b").agg(
        F.count("*").alias("n"), F.count(F.when(F.col(digest).isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("sd") != F.col(digest), 1)).alias("changed"), F.count(F.when(F.col("back"), 1)).alias("back"),
        F.min("at").alias("low"), F.max("at").alias("high"),
    )
    # Neighbouring buckets are compared in groups of ten thousand, and then the groups' ends: a row for each hundred
    # million staged rows is all that one task sees.
    def crossed(w) -> Column:
        return F.coalesce(F.col("low") <= F.lag("high").over(w), F.lit(False)).cast("int")

    grouped = per.withColumn("g", F.floor(F.col("b") / 10_000))
    grouped = grouped.withColumn("across", crossed(Window.partitionBy("g").orderBy("b")))
    sums = [F.sum(c).alias(c) for c in ("n", "missing", "changed", "back", "across")]
    ends = grouped.groupBy("g").agg(*sums, F.min_by("low", "b").alias("low"), F.max_by("high", "b").alias("high"))
    out = ends.withColumn("across", F.col("across") + crossed(Window.partitionBy(F.lit(1)).orderBy("g")))
    return out.agg(
        F.sum("n").alias("staged"), F.sum("missing").alias("missing"), F.sum("changed").alias("changed"),
        (F.sum("back") + F.sum("across")).alias("out_of_order"),
    )


def unique_quote(text: Column, quote: Column) -> Column:
    """struct<start,issue>: where a quote stands if it does so exactly once."""
    n = F.when(quote == "", 0).otherwise(F.size(F.split(text, F.concat(F.lit("\\Q"), quote, F.lit("\\E")))) - 1)
    return F.struct(
        F.when(n == 1, F.instr(text, quote) - 1).alias("start"),
        F.when(n == 0, "quote_not_found").when(n > 1, "quote_not_unique").alias("issue"),
    )


def leaks(text: Column, phrases: list[str]) -> Column:
    """The internal phrases (a stated list) that a training text shows."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(text), F.lower(p)))


def holds_credential(text: Column, credentials: list[str]) -> Column:
    """Whether a configured secret occurs literally."""
    out = F.lit(False)
    for c in credentials:
        out = out | text.contains(c)
    return out


def passages(json: Column) -> Column:
    """array<struct<path,text>> of the strings one or two levels deep in a JSON object."""
    top = F.from_json(json, "map<string,string>")
    inner = lambda v: F.from_json(v, "map<string,string>")

    def one(e: Column) -> Column:
        deep = inner(e["value"])
        return F.when(
            deep.isNotNull(),
            F.transform(F.map_entries(deep), lambda x: F.struct(F.concat_ws("/", e["key"], x["key"]).alias("path"), x["value"].alias("text"))),
        ).otherwise(F.array(F.struct(e["key"].alias("path"), e["value"].alias("text"))))

    return F.flatten(F.transform(F.map_entries(top), one))


def half_claim(phrase: Column, numerator: Column, denominator: Column) -> Column:
    """Whether a stated half comparison holds for a part of a whole; null where nothing is claimed."""
    n, d = numerator.cast("decimal(38,9)"), denominator.cast("decimal(38,9)")
    twice = n * 2
    said = F.lower(phrase)
    return F.when((d <= 0) | (n < 0) | (n > d), None).otherwise(
        F.when(said.isin("less than half", "不到一半", "少于一半"), twice < d)
        .when(said.isin("more than half", "超过一半", "多于一半"), twice > d)
        .when(said.isin("at least half", "至少一半"), twice >= d)
        .when(said.isin("at most half", "至多一半"), twice <= d)
    )


def calculation_issue(operation: Column, baseline: Column, value: Column, reported: Column, kind: Column, scale: Column, unit: Column) -> Column:
    """Why a cited calculation does not hold, or null.

    baseline, value and reported are decimal texts; the tolerance is half a unit
    of the last reported digit.
    """
    number = lambda c: c.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")
    b, v, r = (c.cast("decimal(30,10)") for c in (baseline, value, reported))
    digits = F.length(F.regexp_extract(reported, r"\.([0-9]+)$", 1))
    tolerance = F.pow(F.lit(10.0), -digits) / 2
    difference = (v - b) * F.when(scale == "fraction", 100).otherwise(1)
    expected = (
        F.when(operation == "difference", difference.cast("double")).when(operation == "ratio", (v / b).cast("double"))
        .when(operation == "percent_of", (v / b).cast("double") * 100).when(operation == "relative_change", ((v - b) / b).cast("double") * 100)
    )
    units = (
        F.when(operation == "ratio", "ratio").when(operation.isin("percent_of", "relative_change"), "percent")
        .when(kind == "score", "score_point").when(kind == "proportion", "percentage_point").otherwise("native")
    )
    known = kind.isin("score", "proportion", "quantity") & scale.isin("native", "percent", "fraction")
    return (
        F.when(~(number(baseline) & number(value) & number(reported)), "calculation_decimal")
        .when(~known, "calculation_unknown_quantity")
        .when((kind == "proportion") != scale.isin("percent", "fraction"), "calculation_scale_mismatch")
        .when(~operation.isin("difference", "ratio", "percent_of", "relative_change"), "calculation_unknown_operation")
        .when((operation != "difference") & (b == 0), "calculation_zero_baseline")
        .when(unit != units, "calculation_unit_mismatch")
        .when(F.abs(r.cast("double") - expected) > tolerance + 1e-12, "calculation_value_mismatch")
    )
