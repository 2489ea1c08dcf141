"""Text files by line say what whole files say, at any size of splits."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers

FILES = {
    "a.txt": "héllo\r\nwörld\n".encode(), "b.txt": "中文\n第二行\n\n完".encode("gb18030"), "c.txt": b"\xef\xbb\xbffirst\n\xef\xbb\xbfsecond",
    "d.txt": b"fine\n\xff\xff\nfine\n", "e.txt": "plain\n".encode() + "后来\n".encode("gb18030") + "é\n".encode(), "f.txt": b"\n\n",
    "h.txt": b"\xef\xbb\xbfmarked\n", "i.txt": b"\xef\xbb\xbf" + "文中\n".encode("gb18030"),
}


@pytest.mark.parametrize("split", ["97", "128m"])
def test_lines_make_the_whole_file(spark, tmp_path, split):
    for name, body in FILES.items():
        (tmp_path / name).write_bytes(body)
    rng = random.Random(6)
    long = "".join(rng.choice("ab é\n") for _ in range(900))
    (tmp_path / "g.txt").write_bytes(long.encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = readers.text_lines(spark, str(tmp_path), "*.txt").withColumn("name", F.substring_index("path", "/", -1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    whole = {r.path[-5:]: r for r in readers.texts(spark, str(tmp_path), "*.txt").collect()}
    assert set(whole) == {r.name for r in rows}
    for name, r in whole.items():
        mine = [x for x in rows if x.name == name]
        assert {x.issue for x in mine} == {r.issue}
        if r.issue:
            assert [x.text for x in mine] == [None]
        else:
            assert sorted(x.text for x in mine) == sorted(r.text.replace("\n", "\n\0").removesuffix("\0").split("\0"))
