"""The pipeline stage by stage, each against a brute-force version on its own input."""

import re

import corpus_pipeline
from millrace.llm.shared import stored
from test_llm_near_rule import brute
from test_llm_native import brute_hits


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, seen[-1], sf_dir))
        assert out.columns == columns
        seen.append(out)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in texts[1] for i in good) >= 0.95 * len(good)
    ids = sorted(texts[1])
    roots = brute([texts[1][i] for i in ids], 5, 80)
    assert sorted(texts[2]) == [i for k, i in enumerate(ids) if roots[k] == k]
    assert sorted(texts[3]) == sorted(i for i, t in texts[2].items() if not brute_hits(t, items)[4])
    secret = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"""
    assert sorted(texts[4]) == sorted(i for i, t in texts[3].items() if not re.search(secret, t))
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf_dir)
    assert pieces.select("doc_id").distinct().count() == len(texts[4])
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "ids_crc32").collect())) != []
