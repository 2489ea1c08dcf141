"""Benchmark decontamination by a prefix-filtered set join (native functions only).

A document word is hit when it lies inside an occurrence of a window: ten
consecutive words of a benchmark item, or all words of a shorter item.

1. Each window names one necessary shingle (up to three words): its rarest by
   the frequency of its words over all items.  A containing document must hold
   it, so a prefix of length one suffices.
2. Document shingles meet those names in an equi-join; length and positional
   bounds drop alignments where no window of that name fits.  What is left is
   one row for each (document, item, alignment), not one for each window.
3. Candidates go back to their documents and every window is compared word by
   word; the union of verified windows gives the hit words.

The join of step 2 broadcasts the names only while their size in bytes, item
words included, is checked to stay within ``MAX_BROADCAST_BYTES``; beyond it
Spark shuffles both sides.  Documents are keyed by doc_id (null ids by their text), so no group is
hot; a passage that many documents share costs one row per occurrence.
Texts are read whole, whatever their length; an empty table gives no rows.
Null or empty texts have no words; items without words never match; copies of
items all count; extra columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import ascii_lower, split_words, whole

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW, SHINGLE = 10, 3
MAX_BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(whole(text)), SEPARATOR)


def _shingles(words: Column, size: int) -> Column:
    """array<bigint>: a hash of each run of ``size`` words."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _names(benchmark: DataFrame) -> DataFrame:
    """size, name, item_id, offset, first, last, words: a necessary shingle at ``offset`` of the
    item's words for the windows that start from ``first`` to ``last``."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    counts = items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    placed = items.select("item_id", "words", F.posexplode("words").alias("at", "word")).join(counts, "word")
    # Rarity of a shingle: the sum of its words' log frequencies over all items.
    weights = placed.groupBy("item_id", "words").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", F.log("n").alias("w")))), lambda x: x["w"]
        ).alias("weights")
    )
    size = F.least(F.lit(SHINGLE), F.size("words"))
    width = F.least(F.lit(WINDOW), F.size("words"))
    windows = weights.select(
        "item_id", "words", "weights", size.alias("size"), width.alias("width"),
        F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("start"),
    )
    rarest = F.array_min(
        F.transform(
            F.sequence(F.col("start"), F.col("start") + F.col("width") - F.col("size")),
            lambda i: F.struct(
                F.aggregate(
                    F.slice("weights", i + 1, F.col("size")), F.lit(0.0), lambda a, x: a + x
                ).alias("weight"),
                i.alias("offset"),
            ),
        )
    )["offset"]
    runs = (
        windows.withColumn("offset", rarest)
        .groupBy("item_id", "words", "size", "width", "offset")
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
    )
    name = F.when(F.col("size") == 1, F.xxhash64(F.get("words", F.col("offset"))))
    for k in range(2, SHINGLE + 1):
        name = name.when(
            F.col("size") == k, F.xxhash64(*[F.get("words", F.col("offset") + j) for j in range(k)])
        )
    return runs.withColumn("name", name)


def _key() -> Column:
    return F.coalesce(F.col("doc_id"), F.xxhash64(whole(F.col("text")))).alias("__key")


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_key and the distinct (item_id, align, words) that may hold a window."""
    names = _names(benchmark)
    # Each name carries its item's words: their bytes, headers and the row's own.
    taken = F.sum(64 + 40 * F.size("words") + F.octet_length(F.array_join("words", "")))
    stats = names.groupBy("size").agg(taken.alias("n")).collect()  # SHINGLE rows at most
    if sum(r["n"] for r in stats) <= MAX_BROADCAST_BYTES:
        names = F.broadcast(names)
    words = docs.select(_key(), words_of(F.col("text")).alias("__words"))
    words = words.select("__key", F.size("__words").alias("n"), "__words")
    met = None
    for size in sorted(r["size"] for r in stats) or [SHINGLE]:
        # Exploding the expression itself, not a column of it, keeps the optimizer from
        # inferring a filter that would split the text again for every shingle.
        rows = words.select("__key", "n", F.posexplode(_shingles(F.col("__words"), size)).alias("at", "name"))
        part = rows.join(names.filter(F.col("size") == size), "name")
        met = part if met is None else met.unionByName(part)
    align = F.col("at") - F.col("offset")
    fits = (align + F.col("last") >= 0) & (align + F.greatest("first", -align) + F.col("width") <= F.col("n"))
    return (
        met.filter(fits)
        .select("__key", "item_id", align.alias("align"), "words", "width")
        .groupBy("__key", "item_id", "align", "words", "width")
        .agg(F.lit(1).alias("one"))
        .groupBy("__key")
        .agg(F.collect_list(F.struct("item_id", "align", "words", "width")).alias("__cands"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit, items (array<string>, sorted) and contaminated."""
    keyed = docs.select("*", _key())
    df = keyed.join(candidates(docs, benchmark), "__key", "left")
    df = df.withColumn("__words", words_of(F.col("text")))

    def occurrences(c: Column) -> Column:
        """Starts in the document of the item's windows that occur at this alignment."""
        first = F.greatest(F.lit(0), -c["align"])
        last = F.least(F.size(c["words"]), F.size("__words") - c["align"]) - c["width"]
        return F.when(
            first <= last,
            F.transform(
                F.filter(
                    F.sequence(first, last),
                    lambda j: F.slice("__words", c["align"] + j + 1, c["width"])
                    == F.slice(c["words"], j + 1, c["width"]),
                ),
                lambda j: F.struct(
                    (c["align"] + j).alias("start"),
                    (c["align"] + j + c["width"]).alias("end"),
                    c["item_id"].alias("item_id"),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<start:int,end:int,item_id:bigint>>"))

    none = F.array().cast("array<struct<start:int,end:int,item_id:bigint>>")
    df = df.withColumn(
        "__at",
        F.when(F.col("__cands").isNull(), none).otherwise(F.array_sort(F.flatten(F.transform("__cands", occurrences)))),
    )
    cover = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_hit": cover.cast("long"),
            "items": F.sort_array(F.array_distinct(F.transform("__at", lambda s: s["item_id"].cast("string")))),
        }
    )
    return df.withColumn("contaminated", F.col("n_hit") > 0).drop("__key", "__cands", "__words", "__at")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
