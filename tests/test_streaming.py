import pytest

from pointloom.streaming import frames


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@pytest.fixture
def events(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")


def test_windows(spark, events):
    run(frames.event_windows(events, "ts", "event_type", "value", "1 hour", "10 minutes"), "windows", "complete")
    assert spark.sql("select sum(n) from windows").first()[0] == 1000


def test_decoding_keeps_state(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([("a", 2 * i + f, 1 + f) for f in range(2)], "key string, frame bigint, q bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("key string, frame bigint, q bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(frames.decode_stream(rows, "key", "frame", "q", 0.5), "decoded")
    got = sorted(r.decoded for r in spark.sql("select decoded from decoded").collect())
    assert got == [0.5, 1.5, 2.0, 3.0]


def test_journal_skips_what_is_done(spark, tmp_path):
    done = []
    step = frames.journaled(spark, f"{tmp_path}/journal", lambda df: done.append(df.count()))
    tasks = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, fingerprint string")
    step(tasks, 0)
    step(tasks.union(spark.createDataFrame([("a", "2")], tasks.schema)), 1)
    assert done == [2, 1]
