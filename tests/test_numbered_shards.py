"""Each shard of the numbered lines is one file, whatever adaptive execution does with a join before."""

from millrace.plans import logs

CONF = {"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.shuffle.partitions": "200"}


def test_lines_go_through_a_shard(spark):
    kept = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        rows = logs.s2(spark, "/root/testdata/sf0.01").collect()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for shard in range(4):
        lines = sorted(r.line for r in rows if r.shard == shard)
        at, want = 0, []
        for doc in range(shard, 1000, 4):
            at += 2 if doc % 5 == 0 else 1
            want.append(at)
        assert lines == want
