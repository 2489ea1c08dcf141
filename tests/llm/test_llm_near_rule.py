"""The pipeline's near-duplicate rule: five-word shingles and a similarity of 0.8."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, stages
from test_llm_free import SCHEMA, edited, frame, near_texts, prose


def brute(texts, size, percent):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and root[i] != root[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def small_texts(rng):
    texts = near_texts(rng)
    for size in range(5, 22):
        base = prose(rng, size).split()
        texts += [" ".join(edited(rng, base, 1)) for _ in range(3)] + [" ".join(base[:-1]), " ".join(base[1:-1]), " ".join(base)]
    return texts


def test_bounds_of_a_rule():
    for rule, least, most in ((jaccard_join.Rule(3, 90), 9, 17), (jaccard_join.Rule(5, 80), 4, 7)):
        assert (rule.least_light, rule.max_light) == (least, most)
    assert [jaccard_join.Rule(5, 80).prefix_size(n) for n in (1, 5, 8, 10)] == [1, 2, 2, 3]


@pytest.mark.parametrize("size, percent", [(5, 80), (1, 80)])
def test_components_of_a_rule(spark, size, percent):
    texts = small_texts(random.Random(4))
    got = jaccard_join.join_components(frame(spark, texts, nulls=False), rule=jaccard_join.Rule(size, percent)).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == brute(texts, size, percent)


def test_stage_drops_copies_between_the_limits(spark, sf_dir):
    rng = random.Random(8)
    a, b = prose(rng, 50).split(), prose(rng, 200).split()
    texts = [" ".join(x) for x in (a, [*a[:25], "other", *a[26:]], b, [*b[:90], *prose(rng, 15).split(), *b[105:]])]
    assert brute(texts, 5, 80) == [0, 0, 2, 2] and brute(texts, 3, 90) == [0, 1, 2, 3]
    kept = stages.near_duplicates(spark, spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_stage_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id").isNotNull())
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    roots = brute([texts[i] for i in ids], 5, 80)
    kept = stages.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == [i for k, i in enumerate(ids) if roots[k] == k]
