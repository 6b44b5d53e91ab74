"""Registered queries of the subpackage and the pipeline on the smallest given tables."""

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from riskfold.llm import catalog, warc_store
from riskfold.llm.common import HOT_PARTS, join_groups, prefix_sums, stage_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    norm = lambda rows: sorted(rows, key=repr)
    assert norm([tuple(r) for r in got.select(*columns).collect()]) == norm(want.project(", ".join(columns)).fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(names) and "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in catalog.QUERIES}) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
            after = after.checkpoint()
        if k < 3:
            ids = {r["doc_id"] for r in before.select("doc_id").collect()}
            assert {r["doc_id"] for r in after.select("doc_id").collect()} < ids, name
        before = after
    assert before.count() == corpus_pipeline.run(spark, SF).count() > 0


def test_archive_reconstructs(spark, tmp_path):
    big = "x" * 1200
    rows = [(k, f"http://h/{k}", big) for k in range(5)] + [
        (9, "http://h/a\r\nWARC-Type: revisit\r\n", big), (9, None, big), (10, "u", None), (11, "u", ""), (None, "u", "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit(1))
    warc_store.write_archive(pages, f"{stage_folder(spark)}/test-archive-{tmp_path.name}")
    records = warc_store.read_records(spark, f"{stage_folder(spark)}/test-archive-{tmp_path.name}")
    fields = warc_store.record_fields(records).collect()
    assert len(fields) == len(rows)
    assert sorted((r["page_id"] or -1, r["record_type"]) for r in fields if r["payload_bytes"] == 1200) == sorted(
        [(k or -1, "revisit") for k in range(5)] + [(9, "response"), (9, "revisit")])
    assert {r["refers_to"] for r in fields if r["record_type"] == "revisit"} == {9}
    whole = [bytes(r["record"]) for r in warc_store.record_bytes(records).collect()]
    assert all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") and r.endswith(b"\r\n\r\n") for r in whole)
    for r in whole:
        head, _, rest = r.partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
        assert rest == rest[:length] + b"\r\n\r\n"
    none = f"{stage_folder(spark)}/test-archive-none-{tmp_path.name}"
    warc_store.write_archive(pages.limit(0), none)
    assert warc_store.read_records(spark, none).count() == 0


def test_archive_rejects_damage(spark, tmp_path):
    folder = f"{stage_folder(spark)}/test-archive-bad-{tmp_path.name}"
    warc_store.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), folder)
    store = spark.read.parquet(f"{folder}/payloads").collect()
    frame = zstandard.ZstdCompressor().compress(b"abd")
    spark.createDataFrame([(bytes(r["address"]), frame, 1) for r in store], "address binary, payload binary, users long").write.mode(
        "overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match its address"):
        warc_store.record_fields(warc_store.read_records(spark, folder)).collect()


def test_archive_rejects_wrong_length(spark, tmp_path):
    folder = f"{stage_folder(spark)}/test-archive-length-{tmp_path.name}"
    warc_store.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), folder)
    rows = spark.read.parquet(f"{folder}/records").collect()
    spark.createDataFrame([(r["page_id"], bytes(r["address"]), r["slice"], bytes(r["header"]).replace(b"Content-Length: 3", b"Content-Length: 4"))
                           for r in rows], "page_id long, address binary, slice int, header binary").write.mode("overwrite").parquet(f"{folder}/records")
    with pytest.raises(Exception, match="not as long as its header says"):
        warc_store.record_fields(warc_store.read_records(spark, folder)).collect()


def test_hot_join_and_prefix_sums(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert groups.where(F.col("n") * HOT_PARTS >= 3000).count() <= HOT_PARTS
    assert join_groups(rows, groups, "k", "n", 3000).count() == 3000
    got = prefix_sums(rows, "k", ["id"], "id").where("k = -1").collect()
    assert all(r["__llm_before"] == r["id"] * (r["id"] - 1) // 2 for r in got)
