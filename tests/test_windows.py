"""Windows of a stream that is stopped and started again, with rows within and beyond the watermark."""

import json

from pressloom.streaming import ingest


def test_late_rows_within_and_beyond_the_watermark(spark, tmp_path):
    landing, path, state = (str(tmp_path / x) for x in ("landing", "windows", "state"))

    def run(*times):
        spark.createDataFrame([(t, "a") for t in times], "t string, kind string").selectExpr("CAST(t AS timestamp) AS ts", "kind").coalesce(1).write.mode("append").parquet(landing)
        rows = ingest.events(spark, landing, "ts timestamp, kind string")
        q = ingest.drain(ingest.tumbling(rows, "ts", "1 day", "1 day", "kind"), ingest.into_windows(path), state)
        q.awaitTermination()
        stored = spark.read.parquet(path).selectExpr("CAST(start AS string) AS day", "kind", "n").collect()
        kept = [json.loads(p.json) for p in q.recentProgress] if hasattr(q.recentProgress[0], "json") else q.recentProgress
        return {(r.day[:10], r.kind): r.n for r in stored}, kept[-1]["stateOperators"][0]["numRowsTotal"]

    assert run("2024-01-01 10:00:00", "2024-01-02 09:00:00", "2024-01-02 23:00:00") == ({}, 2)
    # the first day still takes rows, as the watermark stands at 23:00 of it; then the third day closes it
    closed, held = run("2024-01-01 23:30:00", "2024-01-03 12:00:00")
    assert (closed, held) == ({("2024-01-01", "a"): 2}, 2)
    # a row of the closed day is too late, one of the second day isn't
    closed, held = run("2024-01-01 12:00:00", "2024-01-02 23:59:00", "2024-01-05 00:00:00")
    assert closed == {("2024-01-01", "a"): 2, ("2024-01-02", "a"): 3, ("2024-01-03", "a"): 1}
    assert held == 1
