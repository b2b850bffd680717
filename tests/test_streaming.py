"""The usage counter on a stream that goes on."""

import datetime as dt

from pyspark.sql import functions as F

from prismata.streaming import counters


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 5, 1, h, m)
    schema, source, path = "ts timestamp, event_type string, value double", f"{tmp_path}/in", f"{tmp_path}/out"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def counts():
        stream = counters.usage(spark.readStream.schema(schema).parquet(source))
        return {(r.start.hour, r.event_type): (r.n, r.total) for r in counters.run_once(stream, path, "start", "event_type").collect()}

    add([])
    assert counts() == {}
    add([(at(1, 5), "a", 1.0), (at(1, 50), "a", 2.0), (at(2, 0), "b", 4.0)])
    assert counts() == {(1, "a"): (2, 3.0), (2, "b"): (1, 4.0)}
    add([(at(2, 10), "b", 1.5), (at(5, 0), "a", 8.0)])
    assert counts() == {(1, "a"): (2, 3.0), (2, "b"): (2, 5.5), (5, "a"): (1, 8.0)}
    add([(at(1, 30), "a", 100.0), (at(5, 1), "a", 1.0)])  # the first is later than the watermark
    want = {(1, "a"): (2, 3.0), (2, "b"): (2, 5.5), (5, "a"): (2, 9.0)}
    assert counts() == want and counts() == want
    assert spark.read.parquet(source).agg(F.count("*")).first()[0] == 7
