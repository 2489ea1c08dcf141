"""Samples of terms, taken within a row before terms become rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.operators import history
from millrace.plans import ledgers


def test_only_samples_become_rows(spark, tmp_path):
    """Repeated ids count as one key; of long texts 48 terms at most are exploded."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(i // 2, " ".join(word() for _ in range(rng.choice([5, 400, 900]))).title()) for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = ledgers.t4(spark, str(tmp_path)).collect()
    for k in range(6):
        terms = {w for i, t in rows if i == k for w in re.findall("[a-z]+", t.lower())}
        want = sorted(terms, key=lambda t: (hashlib.md5(t.encode()).hexdigest(), t))[:48]
        assert sorted((r.place, r.term) for r in got if r.doc_id == k) == list(enumerate(want, 1))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    assert docs.select(F.max(F.size(history.least(words, F.md5)))).first()[0] == 48
