"""Files, artifacts, table-level scoring and the incremental run."""

import csv
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from expband.functions import signals
from expband.operators import models, textfeat
from expband.plans import score
from expband.plans.artifacts import TrainedModel
from expband.sources import fixtures as fx
from expband.sources import io
from expband.streaming import incremental


@pytest.fixture(scope="module")
def model(spark, sf):
    featured = signals.numeric_features(fx.postings(spark, sf)).drop("doc_id")
    features = textfeat.fit_features(featured)
    rng = np.random.default_rng(3)
    ensemble = models.LinearEnsemble(
        rng.normal(size=(features.size, 12)), rng.normal(size=12),
        {"slope": -np.ones((3, 4)), "offset": np.zeros((3, 4)), "present": np.ones((3, 4), bool)})
    return TrainedModel("logreg_C0.5", 0.55, features, ensemble, {"winner": {"n": 3}})


def write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(rows)


def test_postings_csv_edge_rows(spark, tmp_path):
    body = 'He said "no", then\nleft. \\ end\n'
    write(tmp_path / "jobs.csv", [
        ["Extra", "UniqueJobAdID", "OrigJobTitle", "JobDescription"],
        ["x", "1", "old", "old text"], ["x", "2", "", body], ["x", "1", "new", " padded "],
        ["x", "3", "T", ""]])
    got = {r.job_id: (r.title, r.description)
           for r in io.load_postings(spark, str(tmp_path)).collect()}
    assert got == {"1": ("new", " padded "), "2": ("", body), "3": ("T", "")}


def test_alias_columns(spark):
    df = spark.createDataFrame([("", "b", "t", None), (None, None, None, "d")],
                               "UniqueJobAdID string, job_id string, title string, description string")
    assert [tuple(r) for r in io.resolve_columns(df).collect()] == [("b", "t", ""), ("", "", "d")]


def test_last_wins_prunes_a_hot_key_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("k"), F.col("id").alias("ord"))
    out = io.last_wins(df, "k", ["ord"])
    assert out.filter("k = 'hot'").first().ord == 999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_label_json(spark, tmp_path):
    rows = [{"job_id": 12, "label": 3}, {"job_id": "b", "label": "2", "unsure": True, "title": "t",
                                         "decided_by": None, "extra": 1}]
    (tmp_path / "gold.json").write_text(json.dumps(rows))
    got = io.load_label_records(spark, str(tmp_path / "gold.json"), "gold").collect()
    assert [(r.job_id, r.label, r.unsure, r.title, r.decided_by, r.source) for r in got] == [
        ("12", 3, False, "", "", "gold"), ("b", 2, True, "t", "", "gold")]


def test_prediction_file_is_plain_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", ' a "q", b\nc ', 3, 0.0625, "model", "", "none", True),
         ("2", "", 1, 0.95, "negation", "x", "title", False)],
        "job_id string, title string, label int, confidence double, decided_by string, "
        "evidence_snippet string, evidence_source string, unsure boolean")
    io.write_predictions(df.coalesce(1), str(tmp_path / "all"))
    part = next((tmp_path / "all").glob("part-*.csv"))
    rows = list(csv.reader(open(part, newline="", encoding="utf-8")))
    assert rows == [list(io.PREDICTION_COLUMNS),
                    ["1", ' a "q", b\nc ', "3", f"{0.0625:.3f}", "model", "", "none", "true"],
                    ["2", "", "1", "0.950", "negation", "x", "title", "false"]]
    io.write_predictions(df.coalesce(1), str(tmp_path / "queue"), only_flagged=True)
    part = next((tmp_path / "queue").glob("part-*.csv"))
    assert len(list(csv.reader(open(part, newline="")))) == 2


def test_model_round_trip_scores_alike(spark, sf, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    back = TrainedModel.load(spark, str(tmp_path / "m"))
    assert (back.estimator, back.threshold, back.classes, back.cv_summary) == (
        "logreg_C0.5", 0.55, [1, 2, 3, 4], {"winner": {"n": 3}})
    p = fx.postings(spark, sf)
    assert sorted(score.score(p, back).collect()) == sorted(score.score(p, model).collect())


def test_scoring_is_narrow_and_keeps_every_row(spark, sf, model):
    p = fx.postings(spark, sf)
    rows = p.select(F.lit("").alias("job_id"), "title", "description").unionByName(
        p.limit(1).select(F.lit("").alias("job_id"), F.lit(None).cast("string").alias("title"),
                          F.lit(None).cast("string").alias("description")))
    # read without spreading: any exchange in the plan would be scoring's own
    read = fx.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"), F.lit("CEO").alias("title"),
        F.col("text").alias("description"))
    scored = score.score(read, model)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    flagged = io.review_queue(scored)._jdf.queryExecution().executedPlan().toString()
    assert flagged.count("ArrowEvalPython") == 1
    assert score.score(rows, model).count() == rows.count()


def test_files_in_files_out_and_stream_equals_batch(spark, sf, model, tmp_path):
    p = fx.postings(spark, sf).select("job_id", "title", "description")
    source = str(tmp_path / "in")
    p.repartition(3).write.options(**io.WRITE_OPTIONS).csv(source, quoteAll=True)
    model.save(spark, str(tmp_path / "m"))
    counters = score.score_files(spark, source, str(tmp_path / "out"), str(tmp_path / "m"))
    assert counters["total"] == p.count()
    arriving = incremental.read_arriving(
        spark, source, "job_id string, title string, description string", files_per_batch=1)
    run = incremental.score_arriving(arriving, model, str(tmp_path / "stream"), str(tmp_path / "ck"))
    run.awaitTermination()
    assert run.exception() is None and run.lastProgress["batchId"] >= 2
    stream = spark.read.parquet(str(tmp_path / "stream"))
    batch = score.score(io.resolve_columns(io.read_csv(spark, source)), model)
    assert sorted(stream.collect()) == sorted(batch.collect())
    flagged = batch.filter("unsure").count()
    assert counters["flagged"] == flagged
    again = incremental.score_arriving(arriving, model, str(tmp_path / "stream"), str(tmp_path / "ck"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).count() == p.count()


def test_batch_of_one_file_is_scored_by_all_cores(spark, sf, tmp_path):
    """Only parsing is left to the one task that can read a multi-line file."""
    from expband.functions import rules
    p = fx.postings(spark, sf).select("job_id", "title", "description")
    p.coalesce(1).write.options(**io.WRITE_OPTIONS).csv(str(tmp_path / "in"), quoteAll=True)
    arriving = incremental.read_arriving(
        spark, str(tmp_path / "in"), "job_id string, title string, description string", files_per_batch=1)
    hits = rules.rule_hits(arriving).select("job_id", F.spark_partition_id().alias("task"), "hit")
    hits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("task").distinct().count() == spark.sparkContext.defaultParallelism
    assert sorted(out.select("job_id", "hit").collect()) == sorted(rules.rule_hits(p).select("job_id", "hit").collect())


def test_stream_files_follow_the_input(spark, sf, monkeypatch):
    """More input comes in more files, not larger ones, and still in the same number of batches."""
    from expband.plans import catalog
    want = sorted(catalog.stream_equals_batch(spark, sf).collect())
    seen = []
    read = incremental.read_arriving

    def reading(spark, folder, schema, files_per_batch):
        seen.append((len(spark.read.text(folder).inputFiles()), files_per_batch))
        return read(spark, folder, schema, files_per_batch)
    monkeypatch.setattr(incremental, "read_arriving", reading)
    monkeypatch.setattr(catalog, "ARRIVING_BYTES", 20_000)
    assert sorted(catalog.stream_equals_batch(spark, sf).collect()) == want
    [(files, per_batch)] = seen
    assert files == catalog.ARRIVING_BATCHES * per_batch and per_batch > 1


def test_label_flags_and_values(spark, tmp_path):
    records = ('[{"job_id": "a", "label": 1, "unsure": 1}, {"job_id": "b", "label": "2", "unsure": "yes"},'
               '{"job_id": "c", "label": 3, "unsure": "True"}, {"job_id": "d", "label": 4, "unsure": true},'
               '{"job_id": "e", "label": 4, "unsure": 0}, {"job_id": "f", "label": 4, "unsure": ""},'
               '{"job_id": "g", "label": 4, "unsure": false}, {"job_id": "h", "label": 4}]')
    (tmp_path / "labels.json").write_text(records)
    got = {r.job_id: (r.label, r.unsure) for r in io.load_label_records(spark, str(tmp_path), "gold").collect()}
    assert got == {"a": (1, True), "b": (2, True), "c": (3, True), "d": (4, True), "e": (4, False),
                   "f": (4, False), "g": (4, False), "h": (4, False)}


@pytest.mark.parametrize("label", ["abc", None, "0", "5"])
def test_bad_labels_stop_the_job(spark, label):
    raw = spark.createDataFrame([("a", label, "", "", "", "", "")], io.LABEL_SCHEMA)
    with pytest.raises(Exception, match="not a band"):
        io.normalise_labels(raw, "gold").collect()


def test_three_decimals_as_printf(spark):
    import random
    rng = random.Random(1)
    values = [k / 16384 for k in range(0, 16385, 7)] + [k / 10000 for k in range(0, 10001, 5)]
    values += [rng.random() for _ in range(3000)] + [rng.random() / 500 for _ in range(3000)] + [0.7125, 0.0025, 0.0005, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", io.three_decimals(F.col("v")).alias("t")).collect()
    assert all(r.t == "%.3f" % r.v for r in got)


def test_postings_without_title_or_description(spark, tmp_path):
    (tmp_path / "p.csv").write_text("UniqueJobAdID,Other\n1,x\n2,y\n")
    rows = io.load_postings(spark, str(tmp_path)).collect()
    assert sorted((r.job_id, r.title, r.description) for r in rows) == [("1", "", ""), ("2", "", "")]


def test_save_is_committed_by_pointer(spark, sf, model, tmp_path, monkeypatch):
    from expband.plans import artifacts
    folder = str(tmp_path / "v")
    first = model.save(spark, folder)
    assert TrainedModel.load(spark, folder).threshold == 0.55
    # a second save that breaks after its features, before its meta and pointer
    broken = TrainedModel(model.estimator, 0.7, model.features, model.ensemble, model.cv_summary)
    real = spark.createDataFrame

    def fail_on_meta(data, schema=None, *a, **k):
        if schema == "value string" and "estimator_name" in str(data):
            raise RuntimeError("executor lost")
        return real(data, schema, *a, **k)

    monkeypatch.setattr(spark, "createDataFrame", fail_on_meta)
    with pytest.raises(RuntimeError):
        broken.save(spark, folder)
    monkeypatch.undo()
    assert artifacts.current(spark, folder) == first
    assert TrainedModel.load(spark, folder).threshold == 0.55
    second = broken.save(spark, folder)
    assert [v for _, v in artifacts.versions(spark, folder)] == [first, second]
    assert TrainedModel.load(spark, folder).threshold == 0.7


def test_earlier_layout_is_read(spark, model, tmp_path):
    model.write_tables(spark, str(tmp_path / "old"))
    assert TrainedModel.load(spark, str(tmp_path / "old")).estimator == model.estimator
