"""Toxicity classifier: pooling in blocks, held-out accuracy, defined cases."""

import zlib

import numpy as np
import pandas as pd

from expband.llm import toxicity_cnn

SMALL = toxicity_cnn.Config(buckets=1 << 10, dim=4, filters=5, block=7)


def test_blocks_equal_one_pass():
    net = toxicity_cnn.Net(SMALL)
    rng = np.random.default_rng(1)
    docs = [rng.integers(1, 1 << 10, n) for n in (0, 1, 2, 3, 6, 7, 8, 20, 33)]
    whole = net.pooled(docs)[0]
    for d, want in zip(docs, whole):
        assert np.allclose(net.pooled_long(d), want)
    assert np.allclose(net.features(docs), whole)


def test_gradient_matches_differences():
    net = toxicity_cnn.Net(toxicity_cnn.Config(buckets=64, dim=3, filters=2, rate=1e-6))
    net.p["u"][:] = np.arange(6, dtype=np.float32) / 3 - 0.7
    docs = [np.array([3, 5, 9, 1]), np.array([2]), np.array([], np.int64)]
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        z = net.logits(net.pooled(docs)[0]).astype(np.float64)
        return float(np.sum(np.logaddexp(0, z) - y * z))
    p0 = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grads, rows, emb = net.gradients(docs, y, w)
    grads["emb"] = np.zeros_like(p0["emb"])
    grads["emb"][rows] = emb
    for k in ("u", "c", "w1", "w2", "w3", "b1", "b2", "b3", "emb"):
        analytic = grads[k].reshape(-1)
        for i in range(3 if k == "emb" else 0, analytic.size):  # the pad row stays zero
            net.p = {n: v.copy() for n, v in p0.items()}
            flat = net.p[k].reshape(-1)
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            numeric = (up - loss()) / 2e-6
            assert abs(numeric - analytic[i]) < 1e-4 * max(1.0, abs(numeric)), (k, i, numeric, analytic[i])


def test_held_out_rows_and_defined_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**9, None, None, "x"), (10**9 + 1, "", "en", "y"), (None, "idiot " * 70_000, "en", "z")],
                                  "doc_id long, text string, lang string, score string")
    rows = docs.select("doc_id", "text", "lang", docs.source.alias("score")).unionByName(extra)
    model = toxicity_cnn.fit(rows, spark.read.parquet(f"{sf}/labels.parquet"), toxicity_cnn.Config(epochs=2))
    got = toxicity_cnn.score(rows, model, toxicity_cnn.Config(epochs=2)).toPandas()
    assert len(got) == rows.count()
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    ids = got.doc_id.dropna().astype("int64")
    assert (got.loc[ids.index, "held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]).all()
    assert not got[got.doc_id.isna()].held_out.any()


def test_held_out_accuracy_beats_majority(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity_cnn.of_documents(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet").toPandas()
    lab = pd.read_parquet(f"{sf}/labels.parquet")
    m = got.merge(lab, on="doc_id")
    held = m[m.held_out]
    majority = max(held.toxic.mean(), 1 - held.toxic.mean())
    assert (held.predicted == held.toxic).mean() > majority
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() > 0


def test_every_labelled_training_row_is_learned_from(spark):
    """Shards far smaller than the rows: each row is in one, and their average still beats the majority."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    cfg = toxicity_cnn.Config(shard_rows=80)
    rows = toxicity_cnn.labelled_rows(docs, labels, cfg)
    lab = pd.read_parquet(f"{sf}/labels.parquet")
    ids = {int(i) for i in lab.doc_id if zlib.crc32(str(i).encode()) % 5}
    assert {r.key for r in rows.select("key").collect()} == ids & {r[0] for r in docs.select("doc_id").collect()}
    got = toxicity_cnn.score(docs, toxicity_cnn.fit(docs, labels, cfg), cfg).toPandas().merge(lab, on="doc_id")
    assert (got.predicted == got.toxic).mean() > max(got.toxic.mean(), 1 - got.toxic.mean())


def test_packed_tokens_are_small_and_come_back():
    rng = np.random.default_rng(4)
    for bits in (14, 16, 17, 20):
        for n in (0, 1, 7, 8, 9, 700):
            toks = rng.integers(0, 1 << bits, n)
            assert (toxicity_cnn.unpack(toxicity_cnn.pack(toks, bits), bits) == toks).all()
    assert len(toxicity_cnn.pack(rng.integers(0, 1 << 17, 10_000), 17)) < 0.6 * 4 * 10_000


def test_shards_are_dealt_once(spark):
    """Each shard lies in one task; an epoch reads it there and shuffles no rows."""
    rows = spark.createDataFrame([(i, bytes(8), i % 2) for i in range(4000)], "key long, toks binary, y int")
    kept = toxicity_cnn.dealt(rows, 9)
    assert kept.count() == 4000
    by_task = kept.select("shard").rdd.glom().map(lambda rs: {r[0] for r in rs}).collect()
    assert len(by_task) <= spark.sparkContext.defaultParallelism
    assert sorted(x for task in by_task for x in task) == list(range(9))
    few = toxicity_cnn.dealt(rows, 3)
    assert sorted(len(x) for x in few.select("shard").rdd.glom().map(lambda rs: {r[0] for r in rs}).collect() if x) == [1] * 3
    per_shard = kept.groupBy("shard").applyInPandas(lambda pdf: pdf[["shard"]].head(1), "shard long")
    plan = per_shard._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]
    kept.unpersist()


def test_shuffled_labels_give_the_same_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs.limit(20))
    want = sorted(map(tuple, toxicity_cnn.labelled_rows(docs, labels, SMALL).collect()))
    monkeypatch.setattr(toxicity_cnn.shared, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, toxicity_cnn.labelled_rows(docs, labels, SMALL).collect())) == want and want
