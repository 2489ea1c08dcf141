"""The trigram model counts every document, whatever its label."""

from collections import Counter

from test_llm_free import SCHEMA, labelled

from millrace.llm import toxicity


def test_trigrams_of_all_documents(spark):
    docs, labels = labelled(spark, 60)
    more = [(1000, "quixotic zephyr zephyr", None, None, None), (1001, "quixotic", None, None, None), (None, "sphynx", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    model = toxicity.fit(docs, labels, limit=10)
    want: Counter = Counter()
    for r in docs.collect():
        for w in toxicity.PLAIN.findall((r.text or "").lower()):
            want.update(f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))
    assert model.grams == dict(want) and model.grams["^ze"] == 2 and "phy" in model.grams
