import zlib

import numpy as np

from pointloom.llm import language as L


def test_batch_scores_are_the_sum_over_cells():
    rows = [x.encode() for x in ("Le chat noir", "das haus ist groß", "", "12 34", "el niño" * 50_000, "日本語")]
    matrix = np.log(np.random.default_rng(0).random((1 << 15, 2))).astype(np.float32)
    model = L.Model(["a", "b"], np.log([0.5, 0.5]), matrix, (2, 3), 1 << 15)
    want = np.array([model.priors + L.count_cells(r, (2, 3), 1 << 15) @ matrix.astype(float) for r in rows])
    assert np.allclose(model.scores(rows), want, rtol=1e-9)
    assert model.predict(rows)[0][2:4] == ["und", "und"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = L.op5_language(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_edge_rows(spark):
    train = spark.createDataFrame([(i, "der die das und " * 5, "de") for i in range(20)] + [(i, "the and of with " * 5, "en") for i in range(20, 40)] + [(50, "x", None), (51, None, "de")], "doc_id bigint, text string, lang string")
    model = L.train(train, "doc_id", "text", "lang")
    df = spark.createDataFrame([(1, "the with", 9), (2, None, 9), (3, "123 !", 9), (4, "und das", 9), (4, "und das", 9)], "doc_id bigint, text string, lang_pred int")
    assert sorted((r.doc_id, r.lang_pred) for r in L.identify(df, model).collect()) == [(1, "en"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert sorted(r.doc_id for r in L.keep_identified(df, model).collect()) == [1, 4, 4]
    nothing = L.train(train.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in L.identify(df, nothing).collect()} == {"und"} and L.identify(df.limit(0), model).count() == 0
