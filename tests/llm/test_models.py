"""The quality and toxicity models: held-out accuracy, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import labelled, quality, queries, toxicity

DOC = "doc_id long, text string"
BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return docs, labels.where(part == 0), labels.where(part == 1)


def test_quality_on_held_out_labels(split):
    docs, train, test = split
    got = quality.classify(docs, quality.train(docs, train)).join(test, "doc_id").toPandas()
    right = (got["keep"] == (got["quality"] == 1)).mean()
    clean = got.loc[got["quality"] == 1, "keep"].mean()
    assert right > 0.95 and clean > 0.98


def test_toxicity_on_held_out_labels(split):
    docs, train, test = split
    found = toxicity.severity(docs, toxicity.train(docs, train)).withColumnRenamed("toxic", "found")
    got = found.join(test, "doc_id").toPandas()
    # A part of the positive labels stands on texts without any insult, so recall has a bound below 1.
    assert got.loc[got["toxic"] == 0, "found"].mean() < 0.03 and got.loc[got["toxic"] == 1, "found"].mean() > 0.6
    assert got.loc[got["toxic"] == 1, "severity"].mean() > 5 * got.loc[got["toxic"] == 0, "severity"].mean()


def test_additive_scores_are_sums_of_table_values():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    # The label depends on one feature, and on two together.
    y = ((x[:, 0] > 0.5) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(int)
    model = quality.fit(x[:2000], y[:2000], pairs=3)
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.85
    one = model.base + sum(t[np.searchsorted(c, v, "right")] for c, t, v in zip(model.cuts, model.tables, x[0]))
    one += sum(t[np.searchsorted(cf, x[0, f], "right"), np.searchsorted(cg, x[0, g], "right")] for f, g, cf, cg, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], one)


def test_graded_labels_are_learnt_in_order(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(600):
        g = int(rng.integers(0, 4))
        noise = ["q" + chr(97 + i // 26) + chr(97 + i % 26) for i in rng.integers(0, 400, 30)]
        rows.append((d, " ".join([*noise, *["awful", "nasty", "vile"][:g]]), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df, df.where("doc_id < 400"))
    assert (np.diff(m.thresholds) >= 0).all() and len(m.thresholds) == 3
    got = toxicity.severity(df, m).where("doc_id >= 400").toPandas()
    assert np.corrcoef(got["severity"], [rows[d][2] for d in got["doc_id"]])[0, 1] > 0.9


def test_odd_rows_of_models(spark):
    docs = spark.createDataFrame([(1, "a fine text. It goes on."), (1, "a fine text. It goes on."), (2, None), (3, ""), (None, "x"), (4, "word " * 200_000)], DOC).withColumn("y", F.lit(7)).withColumn("label_id", F.lit("z"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, 1), (None, 1, 1), (99, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for m in (quality.train(docs, labels), quality.train(docs, labels.where("false")), quality.train(docs.where("false"), labels)):
        out = quality.classify(docs, m)
        assert out.count() == 6 and quality.reject(docs, m).columns == docs.columns and quality.classify(docs.where("false"), m).count() == 0
        assert out.where("doc_id = 1").select("quality_score").distinct().count() == 1
    assert quality.reject(docs, quality.Model(base=4.0)).count() == 6
    for m in (toxicity.train(docs, labels), toxicity.train(docs, labels.where("false"))):
        out = toxicity.severity(docs, m)
        assert out.count() == 6 and out.where("severity is null").count() == 0 and toxicity.severity(docs.where("false"), m).count() == 0
    assert {r["label_id"]: r["y"] for r in labelled.sample(labels, "quality", 10).collect()} == {1: 1, 3: 0, 99: 1}
    many = labels.sparkSession.range(6000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert 700 < labelled.sample(many, "quality", 1000).count() <= 1000 and labelled.sample(many, "quality", 6000).count() == 6000


def test_queries_cover_all_documents(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.op5_quality_gam(spark, sf_dir).count() == n and queries.op8_toxicity_ordinal(spark, sf_dir).count() == n
