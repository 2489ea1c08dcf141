"""The divergence audit against a plain version that compares dense tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, item string, term_id string, shard string, n string"


def brute(rows):
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        sources = sorted(s for x, s in counts if x == lang)

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))

        def ranked(s, part, found, limit=None):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:limit], 1))

        for s in sources:
            ranked(s, "pair", [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources if o != s])
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            ranked(s, "term", terms, 10)
    return sorted(out)


def rows(rng, n=400):
    words = ["Haus", "été", "ÉTÉ", "naïve", "x", "日本", "it's"] + [f"{a}{b}o" for a in "bcdfg" for b in "aeiou"]
    weights = [1 / (1 + i) for i in range(len(words))]
    out = []
    for i in range(n):
        own = words[i % 7 :]
        text = " ".join(rng.choices(own, weights[: len(own)], k=rng.randrange(40)))
        out.append((text, rng.choice(["en", "de", None, "e"]), "hot" if i % 3 == 0 else rng.choice([f"s{k}" for k in range(9)] + [None, "É", "~"])))
    out += [(None, "en", "empty"), ("", "only", "a"), ("... 12", "only", "b"), ("rare words here", "few", "a")]
    return out + out[:30]


@pytest.mark.parametrize("shard,dense,tallied", [(1 << 16, 1 << 14, 400_000), (7, 3, 20)])
def test_audit_equals_the_plain_version(spark, monkeypatch, shard, dense, tallied):
    monkeypatch.setattr(divergence, "SHARD_ENTRIES", shard)
    monkeypatch.setattr(divergence, "DENSE", dense)
    monkeypatch.setattr(divergence, "TALLIED", tallied)
    given = rows(random.Random(shard))
    df = spark.createDataFrame([(i, *r, "x", "y", "z", "n") for i, r in enumerate(given)], SCHEMA).repartition(5)
    got = divergence.audit(df).collect()
    assert sorted(tuple(r) for r in got) == brute(given)


def test_an_empty_table_and_one_group(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(i, "word other", "en", "s", "", "", "", "") for i in range(12)], SCHEMA)
    assert divergence.audit(one).count() == 0  # no peers, and no share above the language's


@pytest.mark.parametrize("blocks", [2, 3, 4, 5, 8, 9])
def test_every_two_blocks_meet_once(spark, blocks):
    met = Counter()
    frame = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(blocks).alias("n"))
    for r in range(blocks + blocks % 2 - 1):
        pairs = {tuple(x) for x in frame.select("b", divergence.partner(F.col("b"), r, F.col("n"))).collect()}
        met.update((a, b) for a, b in pairs if b < a)
        real = [(a, b) for a, b in pairs if b < blocks]
        assert all((b, a) in pairs for a, b in real)
    assert met == {(a, b): 1 for a in range(blocks) for b in range(a)}


def test_long_division_stays_exact():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randrange(1, 9 * 10 ** rng.randrange(1, 15))
        kept, n = rng.randrange(1, 1000), rng.randrange(total + 1)
        assert int(divergence.share(n, total, kept)) == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_vectors_survive_packing():
    ids = np.array([9, 2, 1 << 50, 77], np.int64)
    back = divergence.unpack_vector(divergence.pack_vector(ids, ids + 1, ids + 2))
    assert [x.tolist() for x in back] == [sorted(ids.tolist()), sorted((ids + 1).tolist()), sorted((ids + 2).tolist())]
