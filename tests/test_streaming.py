from pyspark.sql import functions as F

from tessera.streaming.upsert import KeyedTable, coverage, until_known
from tessera.streaming.windows import session_counts, tumbling_counts


def test_keyed_table_from_a_stream(spark, tmp_path):
    schema = "k string, v int, at int"
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k":"a","v":1,"at":1}\n{"k":"b","v":2,"at":1}\n')
    state = KeyedTable(spark, str(tmp_path / "state"), ["k"], lambda: [-F.col("at")])
    run = lambda: state.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "2.json").write_text('{"k":"a","v":9,"at":2}\n{"k":"c","v":3,"at":2}\n')
    run()
    assert sorted((r["k"], r["v"]) for r in state.version(1).collect()) == [("a", 9), ("b", 2), ("c", 3)]
    state.apply(spark.createDataFrame([("a", 9, 2), ("c", 3, 2)], schema), 1)  # a batch done twice changes nothing
    assert state.version(1).count() == 3


def test_windows_on_a_stream_match_the_batch(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:{m:02}:00") for m in (0, 5, 50, 55)] + [("w", "2024-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "u string, t string").select("u", F.col("t").cast("timestamp").alias("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = tumbling_counts(stream, "t", "1 hour", "u", late="0 seconds").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = lambda x: sorted((str(r["window_start"]), r["u"], r["n"]) for r in x.collect())
    assert got(spark.table("hours")) == got(tumbling_counts(df, "t", "1 hour", "u"))
    assert sorted(r["n_events"] for r in session_counts(df, "u", "t", "30 minutes").collect()) == [1, 2, 2]


def test_crawl_stops_at_known_rows(spark):
    page = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    got = until_known([page(9, 8), page(8, 7), page(3, 2), page(6)], page(3, 2, 1), ["id"])
    assert sorted(r["id"] for r in got.distinct().collect()) == [7, 8, 9]
    assert coverage(page(1, 2), page(1, 2, 3, 4), ["id"]) == 0.5
