import datetime

from pyspark.sql import functions as F

from coordspark.operators import regions, swaps
from coordspark.streaming import rows

DATA = "row_id long, source_id string, lat_raw string, lon_raw string, at timestamp"
T = datetime.datetime(2024, 5, 1, 12)


def cells(source, start, n, minutes):
    kinds = [("38.7", "-9.1"), ("-9.1", "38.7"), ("37.8", "-25.5"), ("x", "1"), ("100", "40"), ("39.5 W", "-8"), ("10", "10"), ("32.7", "-16.9")]
    return [(start + k, source, *kinds[(start + k * 3) % len(kinds)], T + datetime.timedelta(minutes=minutes + k % 5)) for k in range(n)]


def run(spark, feed, folder, mode):
    query = feed.writeStream.format("memory").queryName("fed").outputMode(mode).option("checkpointLocation", str(folder / f"state-{mode}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [r.asDict() for r in spark.table("fed").collect()]


def test_sources_of_a_feed_decide_as_a_batch(spark, tmp_path):
    batches = [cells("a", 0, 40, 0) + cells("b", 100, 3, 0), cells("a", 40, 30, 10), cells("c", 300, 9, 400)]  # a goes on in the second, c ends the others
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, DATA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    feed = spark.readStream.schema(DATA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    label = lambda df: rows.labelled(df, "lat_raw", "lon_raw", "Portugal mainland")
    got = {r["source_id"]: r for r in run(spark, rows.source_decisions(label(feed), "Portugal mainland", "at"), tmp_path, "append")}
    batch = label(spark.createDataFrame(batches[0] + batches[1], DATA))
    want = {r.source_id: r.asDict() for r in rows.decisions(batch, "Portugal mainland", "source_id").collect()}
    assert set(got) == {"a", "b"} and got["a"]["total"] == 70  # c hasn't ended
    assert {s: {c: r[c] for c in want[s]} for s, r in got.items()} == want
    # and as the batch operators one by one
    figures = {r.source_id: r.asDict() for r in regions.metrics(batch, "source_id", region="Portugal mainland").collect()}
    tokens = {r.source_id: r.token for r in swaps.review_token(batch, "source_id").collect()}
    switch = {r.source_id: (r.region, r.n) for r in regions.best_switch(regions.region_check(batch, "source_id", region="Portugal mainland"), "source_id").collect()}
    for s, r in want.items():
        assert {c: r[c] for c in figures[s]} == figures[s] and r["token"] == tokens[s] and r["switch_n"] == switch.get(s, (None, None))[1]


def test_counts_by_window(spark, tmp_path):
    batch = cells("a", 0, 20, 0) + cells("a", 20, 20, 90)
    spark.createDataFrame(batch, DATA).write.parquet(str(tmp_path / "in"))
    feed = rows.labelled(spark.readStream.schema(DATA).parquet(str(tmp_path / "in")), "lat_raw", "lon_raw", "Portugal mainland")
    spark.sql("drop view if exists fed")
    got = {(r["window"].start, r["status"]): r["n"] for r in run(spark, rows.status_counts(feed, "at"), tmp_path, "complete")}
    table = rows.labelled(spark.createDataFrame(batch, DATA), "lat_raw", "lon_raw", "Portugal mainland")
    want = table.groupBy(F.window("at", "1 hour"), "status").agg(F.count("*").alias("n")).collect()
    assert got == {(r["window"].start, r.status): r.n for r in want}
