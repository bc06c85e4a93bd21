"""Laid-out tables, the feedback source and SQL texts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from assay.plans.catalog import SqlCatalog
from assay.sources import feedback_source as fs
from assay.sources import layout
from assay.streaming import streams

SCHEMA = "scan_id string, agree boolean, note string, at string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    """One key holds a third of all rows; nulls and repeated keys; neither side is moved."""
    a = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id) END AS k", "id AS x")
    b = spark.range(500).selectExpr("concat('k', id * 2) AS k", "id AS y").unionByName(spark.createDataFrame([("hot", 7), (None, 8)], "k string, y long"))
    layout.bucketed_table(a, "left_rows", str(tmp_path / "a"), ["k"], 4)
    layout.bucketed_table(b, "right_rows", str(tmp_path / "b"), ["k"], 4)
    got = layout.joined_in_place(spark, "left_rows", "right_rows", ["k"], "left")
    assert "Exchange" not in plan_of(got) and "SortMergeJoin" in plan_of(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, a.join(b, "k", "left").collect()))
    counts = spark.table("left_rows").groupBy("k").count()
    assert "Exchange" not in plan_of(counts) and counts.filter("k = 'hot'").first()["count"] == 1000
    assert len(list((tmp_path / "a").glob("*.parquet"))) <= 4  # a bucket is a file
    spark.sql("DROP TABLE left_rows")
    spark.sql("DROP TABLE right_rows")


def test_orc_filters_reach_the_files(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "id * 7 % 1000 AS v", "concat('n', id % 9) AS n")
    got = layout.orc_table(rows, str(tmp_path / "o"), ["v"], ["n"]).filter("v > 990 AND n = 'n3'").select("id", "v")
    plan = plan_of(got)
    assert "GreaterThan(v,990)" in plan and "EqualTo(n,n3)" in plan and re.search(r"ReadSchema: struct<id:bigint,v:bigint,n:string>", plan)
    assert sorted(map(tuple, got.collect())) == sorted((i, i * 7 % 1000) for i in range(2000) if i * 7 % 1000 > 990 and i % 9 == 3)


def test_feedback_goes_round(spark, tmp_path):
    """Quotes, line ends, nulls, letters of all planes; small ranges cut lines anywhere."""
    fs.register(spark)
    r = random.Random(1)
    rows = [(f"s{i}", r.choice([True, False, None]), r.choice([None, "", "a\nb", 'q"\\', "日本 🎈" * r.randrange(30)]), str(i)) for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.format("feedback_jsonl").mode("append").save(str(tmp_path))
    spark.createDataFrame(rows[:5], SCHEMA).write.format("feedback_jsonl").mode("append").save(str(tmp_path))
    for split in (7, 100, 1 << 20):
        got = spark.read.format("feedback_jsonl").option("split", split).load(str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows + rows[:5], key=str)
    spark.createDataFrame(rows[:9], SCHEMA).write.format("feedback_jsonl").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("feedback_jsonl").load(str(tmp_path)).count() == 9
    assert spark.read.format("feedback_jsonl").load(str(tmp_path / "none")).count() == 0


def test_lines_that_are_no_feedback(spark, tmp_path):
    fs.register(spark)
    (tmp_path / "a.jsonl").write_text('{"scan_id": "x", "agree": "yes", "note": 5}\n\nnot json\n[1]\n{"scan_id": "last"}')
    got = spark.read.format("feedback_jsonl").load(str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("x", None, "5", None), (None,) * 4, (None,) * 4, ("last", None, None, None)], key=str)


def test_a_restarted_stream_neither_loses_nor_repeats(spark, tmp_path):
    """Files grow between runs and a line is half written; a batch that fails is run again from its offsets."""
    fs.register(spark)
    feed, line = tmp_path / "feed", lambda i: json.dumps({"scan_id": f"s{i}", "agree": True}) + "\n"
    feed.mkdir()
    (feed / "f-1").write_text("".join(line(i) for i in range(10)) + line(10)[:9])
    rows = lambda: spark.readStream.format("feedback_jsonl").option("split", 50).load(str(feed))
    seen = lambda: sorted(r.scan_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run = lambda: streams.run_to_table(rows(), str(tmp_path / "out"), str(tmp_path / "c"))
    run()
    assert seen() == sorted(f"s{i}" for i in range(10))
    with (feed / "f-1").open("a") as f:
        f.write(line(10)[9:] + line(11))
    (feed / "f-2").write_text("".join(line(i) for i in range(12, 20)))

    def broken(batch, number):
        batch.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")  # part of it, then it dies
        raise RuntimeError("killed")

    query = rows().writeStream.foreachBatch(broken).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    run()
    assert seen() == sorted(f"s{i}" for i in range(20))
    run()
    assert seen() == sorted(f"s{i}" for i in range(20))


def test_the_stream_sink_commits_once(spark, tmp_path):
    fs.register(spark)
    spark.createDataFrame([(f"s{i}", True, None, None) for i in range(40)], SCHEMA).write.parquet(str(tmp_path / "in"))
    write = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.format("feedback_jsonl").option("path", str(tmp_path / "lines")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    write()
    write()
    assert spark.read.format("feedback_jsonl").load(str(tmp_path / "lines")).count() == 40
    sink = fs.StreamWriter(spark.createDataFrame([], SCHEMA).schema, {"path": str(tmp_path / "lines")})
    again = sink.write(iter([("new", True, None, None)]))
    sink.commit([again], 0)  # batch 0 again: what it committed stays
    gone = sink.write(iter([("aborted", True, None, None)]))
    sink.abort([gone, None], 5)
    assert spark.read.format("feedback_jsonl").load(str(tmp_path / "lines")).count() == 40
    assert not [p for p in (tmp_path / "lines").iterdir() if p.name.startswith("_")]


def test_sql_texts_read_and_nothing_else(spark):
    catalog = SqlCatalog(spark, {"t": spark.range(10).selectExpr("id", "id % 3 AS g")})
    got = catalog.query("WITH m AS (SELECT g, max(id) AS top FROM t GROUP BY g) SELECT t.id FROM t WHERE id = (SELECT top FROM m WHERE m.g = t.g) AND id > :least", least=7)
    assert sorted(r.id for r in got.collect()) == [8, 9]
    chain = catalog.query("WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x * 2 FROM n WHERE x < :top) SELECT max(x) AS x FROM n", top=500)
    assert chain.first().x == 512
    assert catalog.query("SELECT :v AS v", v="'; DROP VIEW t; --").first().v == "'; DROP VIEW t; --"
    for text in ("DROP VIEW t", "CREATE TABLE x AS SELECT 1", "INSERT INTO t SELECT 1, 2", "SET a = 1", "SHOW TABLES", "CREATE TEMP VIEW v AS SELECT 1", "DELETE FROM t", "CACHE TABLE t", "WITH w AS (SELECT 1) INSERT INTO t SELECT 1, 2 FROM w"):
        with pytest.raises(ValueError, match="only queries"):
            catalog.query(text)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        spark.sql("SELECT * FROM t")  # the names are the catalog's own
    assert SqlCatalog(spark).query("SELECT 1 AS one").select(F.col("one")).first().one == 1
