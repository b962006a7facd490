import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from offerlake.llm import ranges as R
from offerlake.llm import warc_shards as W

PAGES = [(i, f"http://h{i % 3}.org/{i} ü\n", f"<p>{i % 40} é</p>" * (i % 7)) for i in range(300)] + [(1000, None, None), (1001, "u", ""), (10**15, "http://far", "z" * 300000), (None, None, "no id"), (5000, "a", "twin"), (5000, "a", "twin")]


def write(spark, tmp_path, name, parts=4, **kw):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(parts)
    root = f"file://{tmp_path}/{name}"
    return root, W.write_archive(pages, root, **{"shard_bytes": 20000, "roll_bytes": 4000, **kw})


def test_round_trip(spark, tmp_path):
    root, manifest = write(spark, tmp_path, "a")
    got = W.read_archive(spark, root).collect()
    assert len(got) == len(PAGES) and all(r.intact for r in got)
    top = {}
    for i, _, page in PAGES:
        if i is not None:
            top[page or ""] = max(i, top.get(page or "", -1))
    want = sorted((str(i), len((p or "").encode()), base64.b32encode(hashlib.sha1((p or "").encode()).digest()).decode(),
                   "response" if i is None or i == top[p or ""] else "revisit", None if i is None or i == top[p or ""] else top[p or ""]) for i, _, p in PAGES)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    whole = {(r.page_id, r.payload.decode()) for r in got if r.record_type == "response"}
    assert whole == {(i, p or "") for i, _, p in PAGES if i is None or i == top[p or ""]}
    files = manifest.collect()
    assert len(files) > 5 and sum(r.records for r in files) == len(PAGES)
    assert sorted(f for f in os.listdir(tmp_path / "a") if f[0] not in "._") == sorted(r.file for r in files)
    for r in files:
        raw = (tmp_path / "a" / r.file).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == r.sha256 and len(raw) == r.bytes
        assert r.bytes <= 4000 or r.records == 1
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") >= r.records + 1


def test_the_same_files_from_any_partitioning(spark, tmp_path):
    one, two = (sorted((r.file, r.sha256) for r in write(spark, tmp_path, n, parts)[1].collect()) for n, parts in (("b", 1), ("c", 7)))
    assert one == two


def test_small_payloads_and_empty_tables(spark, tmp_path):
    root, _ = write(spark, tmp_path, "d", least_bytes=10**6)
    assert {r.record_type for r in W.read_archive(spark, root).collect()} == {"response"}
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.write_archive(none, f"file://{tmp_path}/e").collect() == []
    assert W.read_archive(spark, f"file://{tmp_path}/e").collect() == []


def test_a_cut_file_is_noticed(spark, tmp_path):
    root, manifest = write(spark, tmp_path, "f")
    name = manifest.first().file
    path = tmp_path / "f" / name
    raw = path.read_bytes()
    with path.open("wb") as f:
        f.write(raw[:-30])
    with pytest.raises(Exception, match="ends inside a record"):
        W.read_archive(spark, root).collect()


def test_even_cuts(spark):
    rows = [(i, 10) for i in range(1000)] + [(10**12, 10), (10**12 + 1, 5000), (-50, 1)]
    df = spark.createDataFrame(rows, "key bigint, weight bigint")
    cuts = R.even_cuts(df, 1000)
    assert cuts == R.even_cuts(df.repartition(9), 1000) and cuts == sorted(set(cuts))
    placed = df.withColumn("r", R.range_of(F.col("key"), cuts)).groupBy("r").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert min(r.r for r in placed) == 1
    assert all(r.w <= 1000 or r.n == 1 for r in placed)
