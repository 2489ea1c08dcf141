"""The near-duplicate stage on a table whose ids repeat."""

import random

from millrace.llm import stages
from test_llm_free import SCHEMA, prose


def test_repeated_ids_are_decided_by_row(spark, sf_dir):
    rng = random.Random(3)
    copied, unique, near = prose(rng, 80), prose(rng, 80), prose(rng, 80).split()
    rows = [
        (1, copied), (5, copied), (5, unique), (7, " ".join(near)), (7, " ".join([*near[:40], "other", *near[41:]])),
        (9, unique + " end"), (8, None), (8, None), (8, ""), (None, copied), (None, copied),
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in stages.near_duplicates(spark, docs, sf_dir).collect()]
    assert kept.count((None, copied)) == 2
    assert sum(i == 7 for i, _ in kept) == 1
    assert sorted((i, t or "") for i, t in kept if i not in (None, 7)) == [(1, copied), (5, unique), (8, ""), (8, "")]
