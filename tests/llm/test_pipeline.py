"""The pipeline against a plain version of its stages."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from test_dedup import brute_groups
from weftline.llm import decontam, pii, quality, sentencepiece_codec as S
from weftline.llm.quality import FEATURES


def test_run_matches_plain_stages(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    train = sorted((d, t) for d, t in docs if d in labels)
    x = quality.features(pa.array([t for _, t in train]))
    order = np.lexsort([*(x[:, f] for f in range(len(FEATURES) - 1, -1, -1)), np.array([d for d, _ in train])])
    model = quality.fit(x[order], np.array([labels[train[k][0]] for k in order]))
    docs = [r for r, s in zip(docs, model.score(quality.features(pa.array([t for _, t in docs])))) if s >= 0]
    groups = brute_groups(docs)
    docs = [r for r in docs if groups[r[0]] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    words = [decontam._words(*decontam._single(t))[0] for _, t in items]
    own = decontam.THRESHOLD * decontam.MATCH * np.array([len(w) for w in words])

    def leaks(t):
        b, _ = decontam._words(*decontam._single(t))
        return len(b) and (decontam.align(words, [b] * len(words))[0] >= own).any()

    key = pii._key(pii.DEFAULT_KEY)
    docs = {d: pii.replace(t, key)[0] for d, t in docs if not leaks(t)}
    c = S.codec(S.default_model())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(docs) and 0 < len(docs)
    for d, t in docs.items():
        off, ids = c.encode_batch(pa.array([t]))
        assert got[d]["text"] == t and got[d]["ids"] == ids.tolist()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
