
import corpus_pipeline as P


def test_stages_on_a_small_table(spark, tmp_path):
    prose = ["the quick brown fox number %d jumps over the lazy dog and runs away from all of them today" % i for i in range(40)]
    leak = "this passage of a public test has more than ten words in it surely"
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(prose)]
    rows += [(100, " ".join(prose[:3]) + "\nown closing line of this one here", "en", "s", 1), (101, "intro words " + leak + " end", "en", "s", 1), (102, "12 34", "en", "s", 5), (103, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        seen.append({r.doc_id for r in docs.collect()})
    assert {102, 103} & seen[0] == set() and 101 in seen[0] and 101 not in seen[3]
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == seen[3] and len({r.sequence_id for r in pieces}) == len(pieces)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    from pointloom.session import BATCH_BYTES

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    rows = [(i, "some words of a text " * 2000, "en", "s", 42000) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in (P.STAGES[0], P.STAGES[3]):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert stage(spark, docs, str(tmp_path)).count() == 400
        seen = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
        assert sum(seen) > 16_000_000 and max(seen) < BATCH_BYTES + 100_000, name
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    P.STAGES[0][1](spark, docs, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
