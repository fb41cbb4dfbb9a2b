from __future__ import annotations

from shroudspark.streaming import live


def test_counts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a@b.example.com"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:03:00", "c@d.example.com"), ("2024-01-01 01:00:00", "10.0.0.1")]
    df = spark.createDataFrame(rows, "at string, text string").selectExpr("CAST(at AS TIMESTAMP) AS at", "text")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = live.counts_by_window(stream, "at")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("live_counts").start()
    try:
        query.processAllAvailable()
        got = {(r["type"], r["n"]) for r in spark.sql("SELECT * FROM live_counts").collect()}
    finally:
        query.stop()
    assert got == {("EMAIL_ADDRESS", 2), ("IP_ADDRESS", 1)}
