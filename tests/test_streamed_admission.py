"""Admission as a stream whose arrivals come late, beside a client whose clock runs ahead."""

from prumo.session import fresh_path
from prumo.streaming.admission import admit_stream

SECOND = 1_000_000
AHEAD = 4_000_000_000  # in 2096


def test_late_arrivals_and_a_clock_ahead(spark):
    batches = [
        [("b", 1, 100_000), ("b", 2, 100_001), ("ahead", 3, AHEAD), ("old", 4, 500_000_000)],
        [("b", 5, 100_005), ("late", 6, 5_000), ("ahead", 7, AHEAD + 1), ("ahead", 8, AHEAD + 2)],
        [("b", 9, 100_700), ("late", 10, 5_001), ("late", 11, 5_002), ("late", 12, 4_000)],
        [("b", 13, 100_701), ("b", 14, 100_702), ("ahead", 15, AHEAD + 900)],
    ]
    source, state, sink = (fresh_path(spark, n) for n in ("late-arrivals", "late-state", "late-admitted"))
    for rows in batches:
        df = spark.createDataFrame([(k, i, t * SECOND) for k, i, t in rows], "k string, id int, at long")
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        run = (
            admit_stream(stream, "k", "at", "id", 2, 600)
            .writeStream.format("parquet").option("checkpointLocation", state).option("path", sink)
            .outputMode("append").trigger(availableNow=True).start()
        )
        run.awaitTermination()
    got = sorted((r.id, r.admitted) for r in spark.read.parquet(sink).collect())
    denied = {5, 8, 11, 14}  # 12 comes first of its batch by time, when one is held
    assert got == [(i, i not in denied) for i in range(1, 16)]
