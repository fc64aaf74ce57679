from datetime import datetime

from kinmatch.runtime import Scratch
from kinmatch.sources.files import query_stream
from kinmatch.streaming import increments

SCHEMA = "posting_id string, title string, ingested_at timestamp"


def run(spark, stream, mode="append"):
    s = Scratch(spark, "test")
    got = []
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{s.root}/state").foreachBatch(lambda df, n: got.extend(df.collect())).start()
    q.awaitTermination()
    return got


def test_streams(spark, tmp_path):
    data = [("a", "Mug  Merah", datetime(2024, 1, 1)), ("a", "Mug  Merah", datetime(2024, 1, 3)), ("b", "x", datetime(2024, 1, 1, 5))]
    spark.createDataFrame(data, SCHEMA).write.json(str(tmp_path / "in"))
    stream = query_stream(spark, str(tmp_path / "in"), SCHEMA)
    assert sorted(r["posting_id"] for r in run(spark, increments.redelivery_free(stream))) == ["a", "b"]
    days = {r["window_start"].day: r["listings"] for r in run(spark, increments.arrivals(stream), "complete")}
    assert days == {1: 2, 3: 1}
    known = spark.createDataFrame([("mug merah", "g1"), (None, "g2")], "title string, label_group string")
    got = {(r["posting_id"], r["known_label_group"]) for r in run(spark, increments.known_titles(stream, known))}
    assert got == {("a", "g1"), ("b", None)}
