"""One DataFrame per operator, over the whole test tables."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.functions import rules, signals, sql
from expband.functions import spans as sp
from expband.operators import breakpoints, combine, folds, metrics, models, textfeat, topk_vocab
from expband.plans import evaluate as evaluation
from expband.plans import score, train
from expband.plans.artifacts import TrainedModel
from expband.sources import fixtures as fx
from expband.sources import csv_split, io, json_split
from expband.streaming import incremental

HIT_FIELDS = ("label", "confidence", "decided_by", "evidence_snippet", "evidence_source",
              "min_years", "max_years")
WORDS = list(rules.lx.NUMBER_WORDS)


# ---------------------------------------------------------------- rule layer

def bands_from_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Postings per band by explicit years mentions in the description."""
    best = rules.add_columns(rules.mentions(fx.postings(spark, sf), "description"), [
        {"years": "array_max(transform(mentions, m -> CASE WHEN m.hi IS NULL THEN m.lo "
                  "ELSE floor((m.lo + m.hi) / 2) END))"},
        {"band": rules.years_to_band("years")}])
    return best.groupBy("band").agg(F.count("*").alias("postings"))


def band_from_years(spark, sf):
    return fx.table(spark, sf, "part").select(
        "p_partkey", "p_size", F.expr(rules.years_to_band("p_size")).alias("band"))


def number_tokens(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    words = F.array(*[F.lit(w) for w in WORDS])
    token = F.when(size <= 20, F.get(words, size)).otherwise(size.cast("string"))
    token = (F.when(key % 5 == 1, F.upper(token)).when(key % 5 == 2, F.concat(F.lit(" "), token))
             .when(key % 5 == 3, F.concat(token, F.lit("x")))
             .when(key % 5 == 4, size.cast("string")).otherwise(token))
    return (fx.table(spark, sf, "part").select("p_partkey", token.alias("token"))
            .withColumn("years", F.expr(rules.parse_number("token"))))


def mentions_long(spark, sf):
    """Mentions of descriptions and titles, both from one scan."""
    def of(field: str) -> Column:
        return F.transform(f"of_{field}", lambda m: F.struct(
            F.lit(field).alias("field"), m["kind"].alias("kind"), m["lo"].alias("lo"), m["hi"].alias("hi"),
            m["start"].alias("start_pos"), m["end"].alias("end_pos")))
    df = fx.postings(spark, sf)
    for field in ("description", "title"):
        df = rules.mentions(df, field, f"of_{field}")
    return df.select("job_id", F.inline(F.concat(of("description"), of("title"))))


def best_mention_band(spark, sf):
    signalled = rules.add_columns(rules.add_signals(fx.postings(spark, sf)), rules.hit_stages())
    return signalled.filter("x_rule = 1").select(
        "job_id", F.col("x_best.anchor").alias("anchor"), F.col("x_best.lo").alias("lo"),
        F.col("x_best.hi").alias("hi"), F.col("hit.label").alias("band"))


def _signals(spark, sf) -> DataFrame:
    return rules.add_signals(fx.postings(spark, sf))


def negation_hits(spark, sf):
    return _signals(spark, sf).filter("x_negation IS NOT NULL").select(
        "job_id", F.col("x_negation.start").alias("start_pos"),
        F.col("x_negation.end").alias("end_pos"))


def edu_hits(spark, sf):
    return _signals(spark, sf).filter("x_edu IS NOT NULL").select(
        "job_id", F.col("x_edu.years").alias("years"), F.col("x_edu.start").alias("start_pos"),
        F.col("x_edu.end").alias("end_pos"))


def mgmt_hits(spark, sf):
    return _signals(spark, sf).filter("x_management IS NOT NULL").select(
        "job_id", F.col("x_management.n").alias("n"),
        F.col("x_management.start").alias("start_pos"), F.col("x_management.end").alias("end_pos"))


def _page_titles(spark, sf) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return fx.texts(spark, sf, "pages", "page_id", "html").select("page_id", title.alias("title"))


def title_signals(spark, sf):
    titles = fx.postings(spark, sf).select("job_id", "title").unionByName(
        _page_titles(spark, sf).select(F.concat(F.lit("P"), "page_id").alias("job_id"), "title"))
    s = rules.add_signals(titles.withColumn("description", F.lit("")))
    return s.select("job_id", "title", F.col("x_senior").alias("senior"),
                    F.col("x_executive").alias("executive"),
                    F.col("x_strong_title").alias("strong"), F.col("x_seniority").alias("seniority"))


def sentences(spark, sf):
    rows = rules.sentences(fx.texts(spark, sf, "documents", "doc_id", "text"), "text").select(
        "doc_id", "text", F.posexplode("sentences").alias("idx", "s"))
    again = F.expr(sp.strip("substring(text, s.start + 1, s.`end` - s.start)"))
    return rows.select("doc_id", "idx", F.col("s.text").alias("sentence"),
                       (again == F.col("s.text")).alias("offsets_fit"))


def _hits(spark, sf) -> DataFrame:
    return rules.rule_hits(fx.postings(spark, sf))


def evidence(spark, sf):
    return _hits(spark, sf).filter("hit IS NOT NULL").select(
        "job_id", "hit.evidence_snippet", "hit.evidence_source")


def rule_hits(spark, sf):
    return _hits(spark, sf).select("job_id", *[f"hit.{c}" for c in HIT_FIELDS])


def numeric_features(spark, sf):
    f = signals.log_lengths(signals.numeric_features(fx.postings(spark, sf)))
    return f.select("job_id", *[F.round(c, 6).alias(c) if c in signals.LOG_FEATURES else F.col(c)
                                for c in signals.NUMERIC_FEATURES])


def doc_lengths(spark, sf):
    docs = fx.texts(spark, sf, "documents", "doc_id", "text").withColumn("title", F.lit(""))
    f = signals.numeric_features(docs, "title", "text")
    return f.select("doc_id", *[F.col(c).cast("bigint").alias(c)
                                for c in ("jd_char_len", "jd_word_len", "bullet_count")])


def sql_functions(spark, sf):
    sql.register(spark)
    fx.postings(spark, sf).createOrReplaceTempView("expband_postings")
    return spark.sql(
        "SELECT job_id, h.label, h.decided_by, size(m) AS n_mentions, yoe_band(h.min_years) AS min_band "
        "FROM (SELECT job_id, yoe_hit(title, description) AS h, yoe_mentions(description) AS m "
        "FROM expband_postings)")


# ------------------------------------------------------------- sources, joins

def last_wins(spark, sf):
    return io.last_wins(fx.table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value")


def alias_columns(spark, sf):
    d = F.col("doc_id")
    raw = fx.postings(spark, sf).select(
        F.when(d % 3 == 0, F.col("job_id")).when(d % 3 == 1, "").alias("UniqueJobAdID"),
        F.concat(F.lit("alt-"), "job_id").alias("job_id"),
        F.when(d % 2 == 0, F.col("title")).otherwise("").alias("OrigJobTitle"), "description")
    out = io.resolve_columns(raw)
    return textfeat.model_inputs(out).select(
        "job_id", "title", F.length("description").alias("n_chars"))


def label_join(spark, sf):
    labels = fx.label_records(spark, sf).withColumn("title", F.lit("from label")).drop("doc_id")
    p = fx.postings(spark, sf).withColumn(
        "title", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("title")))
    return io.join_labels(labels, p).select(
        "job_id", "title", F.length("description").alias("n_chars"), "label", "source", "unsure")


def label_unmatched(spark, sf):
    return io.unmatched_labels(fx.label_records(spark, sf), fx.postings(spark, sf))


def sample_weights(spark, sf):
    return fx.label_records(spark, sf).select(
        "job_id", "source", "unsure", folds.sample_weight().alias("weight"))


def class_weights(spark, sf):
    return folds.class_weights(fx.label_records(spark, sf)).select(
        "label", "n", F.round("class_weight", 9).alias("class_weight"))


def _folds(spark, sf) -> DataFrame:
    gold = fx.label_records(spark, sf).filter("source = 'gold'")
    return folds.stratified_folds(gold, train.CV_FOLDS)


def fold_assignment(spark, sf):
    return _folds(spark, sf).select("job_id", "label", "fold")


def fold_sizes(spark, sf):
    return _folds(spark, sf).groupBy("label", "fold").agg(F.count("*").alias("n"))


def fold_union(spark, sf):
    gold = _folds(spark, sf)
    silver = fx.label_records(spark, sf).filter("source <> 'gold'").withColumn("fold", F.lit(-1))
    both = gold.unionByName(silver).withColumn(
        "test_fold", F.explode(F.array(*[F.lit(i) for i in range(train.CV_FOLDS)])))
    return both.filter("fold <> test_fold").groupBy("test_fold", "source").agg(
        F.count("*").alias("n_train"), F.sum("label").alias("label_sum"))


# -------------------------------------------------------------- text features

def word_ngrams_df(spark, sf):
    docs = fx.texts(spark, sf, "documents", "doc_id", "text").select(
        F.lit("").alias("title"), F.col("text").alias("description"))
    stats = textfeat.term_statistics(textfeat.terms(docs, [], description_chars=None), "desc_word")
    return textfeat.vocabulary(stats, 2, textfeat.MAX_TERMS["desc_word"]).select(
        "term", F.col("df").cast("bigint").alias("df"), "cf")


def char_ngrams_df(spark, sf):
    pages = _page_titles(spark, sf).withColumn("description", F.lit(""))
    stats = textfeat.term_statistics(textfeat.terms(pages, []), "title_char")
    return textfeat.vocabulary(stats, 1, textfeat.MAX_TERMS["title_char"]).select(
        "term", F.col("df").cast("bigint").alias("df"), "cf")


def _weights(df: DataFrame, key: str) -> DataFrame:
    """``key, w``: weights of the description block, fitted and applied to whole texts."""
    by_doc = textfeat.terms(df, [key], description_chars=None).select(key, "desc_word")
    kept = textfeat.vocabulary(textfeat.term_statistics(by_doc, "desc_word"), 2,
                               textfeat.MAX_TERMS["desc_word"])
    rows = kept.select("term", textfeat.smooth_idf(F.col("df"), df.count()).alias("idf")).collect()  # capped
    vocab = [("desc_word", r.term, i, r.idf) for i, r in enumerate(rows)]
    weights = textfeat.weigher([r.idf for r in rows], [textfeat.BLOCKS.index("desc_word")] * len(rows))
    return textfeat.counted(by_doc, vocab).select(key, weights("x_at", "x_tf").alias("w"))


def tfidf_weights(spark, sf):
    turns = fx.table(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", F.col("turn").cast("string")).alias("key"),
        F.lit("").alias("title"), F.col("text").alias("description"))
    return _weights(turns, "key").select("key", F.explode("w").alias("w")).select(
        "key", F.round("w", 6).alias("w"))


def tfidf_documents(spark, sf):
    docs = fx.texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.lit("").alias("title"), F.col("text").alias("description"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return _weights(docs, "doc_id").filter(F.size("w") > 0).select(
        "doc_id", F.size("w").cast("bigint").alias("n_terms"),
        F.round(total, 6).alias("sum_w"), F.round(F.array_max("w"), 6).alias("max_w"))


def maxabs_scaled(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    top = textfeat.max_abs(items, names).select(*[F.col(c).alias(f"x_{c}") for c in names])
    # one row on the right
    return items.join(F.broadcast(top), F.lit(True)).select(
        "l_orderkey", "l_linenumber",
        *[F.round(textfeat.max_abs_scaled(F.col(c), F.col(f"x_{c}")), 9).alias(c) for c in names])


# ------------------------------------------------------- combiner, evaluation

def top2_margin(spark, sf):
    return combine.top2(fx.probabilities(spark, sf)).select(
        "vec_id", "model_label", F.round("model_conf", 6).alias("model_conf"),
        F.round("margin", 6).alias("margin"))


def argmax_low_tie(spark, sf):
    return fx.probabilities(spark, sf).select(
        "vec_id", combine.argmax_low_tie(F.col("proba")).alias("model_pred"))


def _combinable(spark, sf, truth: DataFrame | None = None) -> DataFrame:
    """Postings with hit, executive flag and synthetic probabilities.

    With truth, only the labelled ones: labels are joined before the rules read a text.
    """
    df = fx.posting_probabilities(spark, sf)
    if truth is not None:
        df = df.join(truth, "job_id")
    df = rules.add_columns(rules.add_signals(df), rules.hit_stages())
    return rules.drop_signals(df.withColumn("executive", F.col("x_executive")))


def _combined(spark, sf) -> DataFrame:
    return combine.combine(_combinable(spark, sf), combine.DEFAULT_THRESHOLD)


def combined(spark, sf):
    return _combined(spark, sf).select(
        "job_id", "label", F.round("confidence", 6).alias("confidence"), "decided_by",
        "evidence_snippet", "evidence_source", "unsure")


def combine_eval(spark, sf):
    return combine.sweep(_combinable(spark, sf)).select("job_id", "threshold", "label", "unsure")


def review_queue(spark, sf):
    return io.prediction_rows(io.review_queue(_combined(spark, sf)))


def score_counters(spark, sf):
    predictions, seen = score.counted(_combined(spark, sf))
    predictions.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame(
        [(got["total"], got["flagged"], round(got["flagged_share"], 9))],
        "total bigint, flagged bigint, flagged_share double")


def _labelled(spark, sf) -> DataFrame:
    """Labelled postings with truth, hit, probabilities and the model's own label."""
    truth = fx.label_records(spark, sf).select("job_id", F.col("label").alias("truth"), "source")
    return _combinable(spark, sf, truth).withColumn(
        "model_pred", combine.argmax_low_tie(F.col("proba")))


def _evaluated(spark, sf) -> DataFrame:
    return combine.combine(_labelled(spark, sf), combine.DEFAULT_THRESHOLD)


def confusion(spark, sf):
    return metrics.confusion(_evaluated(spark, sf))


def confusion_kept(spark, sf):
    return metrics.confusion(_evaluated(spark, sf).filter("NOT unsure"))


def class_report(spark, sf):
    r = metrics.class_report(_evaluated(spark, sf))
    return r.select("row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


def macro_f1(spark, sf):
    return metrics.macro_f1(_evaluated(spark, sf), ["source"]).select(
        "source", F.round("macro_f1", 9).alias("macro_f1"))


def label_distribution(spark, sf):
    sides = F.array(F.struct(F.lit("true").alias("side"), F.col("truth").alias("label")),
                    F.struct(F.lit("pred").alias("side"), F.col("label").alias("label")))
    return (_evaluated(spark, sf).select(F.inline(sides)).groupBy("label", "side")
            .agg(F.count("*").alias("n")).select("label", "n", "side"))


RATES = ("model_only_accuracy", "model_only_macro_f1", "hybrid_accuracy", "hybrid_macro_f1",
         "hybrid_mae", "coverage", "kept_accuracy", "flagged_pct")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in RATES})


def summary(spark, sf):
    e = _evaluated(spark, sf).withColumns({
        "estimator": F.lit("synthetic"), "threshold": F.lit(combine.DEFAULT_THRESHOLD)})
    return _rounded(metrics.summary(e))


def _sweep(spark, sf) -> DataFrame:
    swept = combine.sweep(_labelled(spark, sf)).withColumn("estimator", F.lit("synthetic"))
    return metrics.summary(swept)


def threshold_sweep(spark, sf):
    return _rounded(_sweep(spark, sf))


def threshold_sweep_bp(spark, sf):
    """threshold_sweep by breakpoints: one aggregate, no row per row and threshold."""
    df = _labelled(spark, sf).withColumn("estimator", F.lit("synthetic"))
    return _rounded(breakpoints.sweep_summary(df))


def threshold_choice(spark, sf):
    return _rounded(metrics.choose_threshold(_sweep(spark, sf)))


def winner(spark, sf):
    """The best of three candidates that differ in how probabilities are assigned."""
    names = ("candidate_a", "candidate_b", "candidate_c")
    p = F.col("proba")
    turned = [p, F.concat(F.slice(p, 2, 3), F.slice(p, 1, 1)), F.reverse(p)]
    variants = F.array(*[F.struct(F.lit(n).alias("estimator"), v.alias("proba"))
                         for n, v in zip(names, turned)])
    rows = _labelled(spark, sf).withColumn("x_v", F.explode(variants)).withColumns({
        "estimator": F.col("x_v.estimator"), "proba": F.col("x_v.proba"),
        "threshold": F.lit(combine.DEFAULT_THRESHOLD)})
    rows = rows.withColumn("model_pred", combine.argmax_low_tie(F.col("proba")))
    summaries = metrics.summary(combine.combine(rows, F.col("threshold")))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("estimator"))
    return _rounded(metrics.choose_winner(summaries, order))


def rule_precision_bucket(spark, sf):
    r = metrics.rule_precision_by_bucket(_labelled(spark, sf))
    return r.select("bucket", "fired", "correct", F.round("precision", 9).alias("precision"),
                    F.round("fired_share", 9).alias("fired_share"))


def rule_precision_by_rule(spark, sf):
    r = metrics.rule_precision_by_rule(_labelled(spark, sf))
    return r.select("decided_by", "fired", "correct", F.round("precision", 9).alias("precision"),
                    F.round("fired_share", 9).alias("fired_share"))


# ------------------------------------------------- files, training, streaming

def _folder(spark: SparkSession, name: str) -> str:
    """A new folder on the storage all executors share."""
    return f"{io.shared_folder(spark)}/expband-{name}-{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf):
    folder = _folder(spark, "csv")
    raw = fx.postings(spark, sf).select(
        F.col("job_id").alias("UniqueJobAdID"), F.col("title").alias("OrigJobTitle"),
        F.col("description").alias("JobDescription"), F.lit("ignored").alias("Extra"))
    raw.write.mode("overwrite").options(**io.WRITE_OPTIONS).csv(folder, quoteAll=True)
    return io.load_postings(spark, folder).select(
        "job_id", "title", F.md5(F.regexp_replace("description", r"\r\n?", "\n")).alias("digest"))


def csv_split_scan(spark, sf):
    """The postings CSV read by byte ranges with a quote-parity scan; the same rows as csv_roundtrip."""
    folder = _folder(spark, "csv-split")
    raw = fx.postings(spark, sf).select(
        F.col("job_id").alias("UniqueJobAdID"), F.col("title").alias("OrigJobTitle"),
        F.col("description").alias("JobDescription"), F.lit("ignored").alias("Extra"))
    raw.write.mode("overwrite").options(**io.WRITE_OPTIONS).csv(folder, quoteAll=True)
    read = csv_split.read_csv(spark, folder)
    named = read.select(F.coalesce(io.ID_NAMES[0], F.lit("")).alias("job_id"),
                        io.first_filled(read, io.TITLE_NAMES[:1]).alias("title"),
                        io.first_filled(read, io.DESCRIPTION_NAMES[:1]).alias("description"), "x_file", "x_order")
    return io.last_wins(named, "job_id", ["x_file", "x_order"]).select(
        "job_id", "title", F.md5(F.regexp_replace("description", r"\r\n?", "\n")).alias("digest"))


def json_labels(spark, sf):
    folder = _folder(spark, "json")
    rows = fx.label_records(spark, sf).select("job_id", "label", "unsure")
    io.write_label_records(rows, folder)
    return io.load_label_records(spark, folder, "gold").select(
        "job_id", "label", "unsure", "title", "decided_by", "source")


def json_split_scan(spark, sf):
    """Label arrays read by byte ranges with composable state tables; the same rows as json_labels."""
    folder = _folder(spark, "json-split")
    rows = fx.label_records(spark, sf).select("job_id", "label", "unsure")
    io.write_label_records(rows, folder)
    raw = json_split.read_json(spark, folder, io.LABEL_SCHEMA).drop("x_file", "x_order")
    return io.normalise_labels(raw, "gold").select("job_id", "label", "unsure", "title", "decided_by", "source")


def vocab_bounds(spark, sf):
    """word_ngrams_df's vocabulary by the threshold algorithm: only terms that can reach it are shuffled."""
    docs = fx.texts(spark, sf, "documents", "doc_id", "text").select(
        F.lit("").alias("title"), F.col("text").alias("description"))
    arrays = textfeat.terms(docs, [], description_chars=None)
    return topk_vocab.vocabulary(arrays, "desc_word", 2, textfeat.MAX_TERMS["desc_word"]).select(
        "term", F.col("df").cast("bigint").alias("df"), "cf")


STATED_TERMS = 300


def train_oof(spark, sf):
    labelled = io.join_labels(fx.label_records(spark, sf), fx.postings(spark, sf))
    oof = train.out_of_fold(train.prepare(labelled), models.CANDIDATES["logreg_C0.5"])
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    best = F.get("proba", F.col("model_pred") - 1) == F.array_max("proba")
    return oof.select("job_id", "truth", "fold", F.round(total, 6).alias("sum_proba"), best.alias("is_best"))


def _featured(spark, sf):
    """Postings with their numeric features, computed once and read by column afterwards."""
    return io.written(signals.numeric_features(fx.postings(spark, sf)).select(
        "job_id", "title", "description", *signals.NUMERIC_FEATURES), "featured")


def _stated_model(spark, rows) -> TrainedModel:
    """Features fitted on the postings, weights by a formula; saved and loaded again."""
    features = textfeat.fit_features(rows, description_chars=None, max_terms={
        "title_word": 0, "title_char": 0, "desc_word": STATED_TERMS})
    folds_, bands = models.CALIBRATION_FOLDS, len(models.BANDS)
    place, slot = np.arange(len(features.vocab))[:, None], np.arange(folds_ * bands)
    weights = ((place * 7 + slot * 13) % 17 - 8) / 4.0
    numbers = np.zeros((len(features.scales), folds_ * bands))
    ensemble = models.LinearEnsemble(np.concatenate([weights, numbers]), slot / 10.0, {
        "slope": -np.ones((folds_, bands)), "offset": np.zeros((folds_, bands)),
        "present": np.ones((folds_, bands), dtype=bool)})
    folder = _folder(spark, "model")
    TrainedModel("stated", combine.DEFAULT_THRESHOLD, features, ensemble).save(spark, folder)
    return TrainedModel.load(spark, folder)


def artifact_roundtrip(spark, sf):
    """Probabilities by a saved and loaded model."""
    df = _featured(spark, sf)
    return score.add_probabilities(df, _stated_model(spark, df)).select(
        "job_id", *[F.round(F.get("proba", i), 6).alias(f"p{i + 1}") for i in range(len(models.BANDS))])


def score_model(spark, sf):
    """Predictions of all postings by a saved and loaded model."""
    return score.score(fx.postings(spark, sf), _stated_model(spark, _featured(spark, sf))).withColumn(
        "confidence", F.round("confidence", 6))


# Batches that arrive, and bytes of the documents that go to one file.
ARRIVING_BATCHES, ARRIVING_BYTES = 4, 4 << 20


def stream_equals_batch(spark, sf):
    """Posting files scored as a stream of batches with the rule layer."""
    source, target, marks = (_folder(spark, n) for n in ("in", "out", "marks"))
    per_batch = -(-io.estimated_bytes(fx.table(spark, sf, "documents")) // (ARRIVING_BATCHES * ARRIVING_BYTES))
    fx.postings(spark, sf).select("job_id", "title", "description").repartition(ARRIVING_BATCHES * per_batch) \
        .write.mode("overwrite").options(**io.WRITE_OPTIONS).csv(source, quoteAll=True)
    arriving = incremental.read_arriving(
        spark, source, "job_id string, title string, description string", per_batch)
    flat = rules.rule_hits(arriving).select("job_id", "hit.label", "hit.decided_by")
    run = (flat.writeStream.format("parquet").option("path", target)
           .option("checkpointLocation", marks).trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.parquet(target)


def report_json(spark, sf):
    folder = _folder(spark, "report")
    rows = io.checkpointed(_labelled(spark, sf).drop("description"))
    at = combine.combine(rows, combine.DEFAULT_THRESHOLD).withColumns({
        "estimator": F.lit("synthetic"), "threshold": F.lit(combine.DEFAULT_THRESHOLD)})
    swept = combine.sweep(rows).withColumn("estimator", F.lit("synthetic"))
    tables = {"summary": metrics.summary(at), "confusion": metrics.confusion(at),
              "distribution_true": metrics.distribution(at, "truth"),
              "distribution_pred": metrics.distribution(at, "label"),
              "sweep": metrics.summary(swept)}
    evaluation.write_report(tables, folder)
    back = spark.read.json(folder)
    return back.select(
        "estimator", "threshold", F.round("summary.hybrid_accuracy", 9).alias("hybrid_accuracy"),
        F.size("threshold_sweep").alias("n_thresholds"),
        F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"),
                    lambda a, x: a + x).alias("n_rows"))


CATALOG = {f.__name__: f for f in (
    bands_from_mentions, band_from_years, number_tokens, mentions_long, best_mention_band,
    negation_hits, edu_hits, mgmt_hits, title_signals, sentences, evidence, rule_hits,
    numeric_features, doc_lengths, sql_functions, last_wins, alias_columns, label_join,
    label_unmatched, sample_weights, class_weights, fold_assignment, fold_sizes, fold_union,
    word_ngrams_df, char_ngrams_df, tfidf_weights, tfidf_documents, maxabs_scaled, top2_margin,
    argmax_low_tie, combined, combine_eval, review_queue, score_counters, confusion,
    confusion_kept, class_report, macro_f1, label_distribution, summary, threshold_sweep,
    threshold_choice, winner, rule_precision_bucket, rule_precision_by_rule, csv_roundtrip,
    json_labels, train_oof, artifact_roundtrip, score_model, stream_equals_batch, report_json,
    csv_split_scan, json_split_scan, vocab_bounds, threshold_sweep_bp,
)}
