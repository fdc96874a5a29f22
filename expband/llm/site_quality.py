"""Document quality from a classifier and hierarchical site posteriors.

A classifier gives each document evidence for two labels, quality and toxic. Per label, the share of
positive documents of a host is drawn to the global share, and that of a path to its host's; how
strongly follows from how much hosts (paths) really differ, by the method of moments. Sparse sites
thus keep near the prior and large ones speak for themselves. A document's posterior adds its
evidence to its path's prior odds.

Shares count every document: labelled ones by their label, others by the classifier's probability.
The classifier (logistic regression on text shape and on the presence of the most telling words) is
fit on at most ``fit_rows`` labelled documents, chosen by a hash of doc_id.

Defined cases: null and empty texts have an all-zero shape and no words, hence the classifier's
intercept; a null host or path is the site ""; documents whose labels repeat or differ count as of
low quality if any label says so, and toxic if any says so; null labels are none; without any
label, or with labels of one kind only, the evidence is 0 and the shares are the smoothed counts;
labels of a null doc_id are left out; rows that repeat a doc_id are rows of their own. Whole texts
are read; extra columns are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.llm import blocks, line_rules, shared
from expband.llm.license_index import BREAKS

SHAPE = ("log_words", "mean_length", "symbols", "repeated", "lost", "dup_lines", "upper", "digits")
HEADS = ("quality", "toxic")


@dataclass(frozen=True)
class Fit:
    fit_rows: int = 20_000      #: most labelled documents the classifier is fit on
    words: int = 300            #: words whose presence it sees
    least_documents: int = 4    #: a word must occur in so many of them
    penalty: float = 1.0        #: weight of the squared coefficients
    threshold: float = 0.5      #: a document is kept at this quality or more, and below this toxicity


def _shape(texts: pa.Array) -> np.ndarray:
    """Text shape, one row per text."""
    counts, _, _ = line_rules.examine(texts, line_rules.Limits())
    raw, offsets = blocks.text_bytes(texts)
    n = np.maximum(counts["n_words"], 1)
    chars = np.maximum(counts["word_chars"], 1)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / chars

    return np.stack([np.log1p(counts["n_words"]), counts["word_chars"] / n / 10.0,
                     np.minimum(counts["n_symbols"] / n, 4.0), counts["n_repeat_words"] / n,
                     counts["n_lost_words"] / n, np.minimum(counts["n_dup_lines"] / n * 10, 4.0),
                     share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57))], axis=1)


def _present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of each text, joined, and their rows."""
    words = blocks.Words(texts, lower=True, breaks=BREAKS)
    values, at = blocks.distinct_by_row(words.hashes(), words.row, len(words.counts))
    return values, np.repeat(np.arange(len(words.counts)), np.diff(at))


def _inputs(texts: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """Shape, then presence of each vocabulary word (sorted hashes)."""
    values, row = _present(texts)
    out = np.zeros((len(texts), len(SHAPE) + len(vocabulary)), np.float32)
    out[:, :len(SHAPE)] = _shape(texts)
    if len(vocabulary) and len(values):
        at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        hit = vocabulary[at] == values
        out[row[hit], len(SHAPE) + at[hit]] = 1.0
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """doc_id, text, quality, toxic: at most about fit_rows labelled documents, by hash of doc_id."""
    known = one_label_each(labels)
    share = min(1.0, fit.fit_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    side = F.broadcast(chosen)  # fit_rows rows of three numbers
    return docs.select("doc_id", "text").join(side, "doc_id")


def one_label_each(labels: DataFrame) -> DataFrame:
    return (labels.filter("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
            .filter("quality IS NOT NULL AND toxic IS NOT NULL"))


def telling_words(sample: DataFrame, fit: Fit) -> np.ndarray:
    """Hashes of the words whose presence says most about either label (largest z statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text", 1 << 22):
                    values, row = _present(part.column("text"))
                    word, at = np.unique(values, return_inverse=True)
                    marks = [np.ones(part.num_rows)] + [part.column(h).to_numpy(zero_copy_only=False) for h in HEADS]
                    sums = [np.bincount(at, m[row], minlength=len(word)) for m in marks]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks.signed(word)), *map(pa.array, sums)],
                                                     names=["word", "n", *HEADS])

    counts = (sample.mapInArrow(run, "word bigint, n double, quality double, toxic double")
              .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)]).filter(F.col("n") >= fit.least_documents))
    total = sample.agg(F.count("*"), *[F.avg(h) for h in HEADS]).first()
    if not total[0]:
        return np.zeros(0, np.uint64)

    def z(head: str, rate: float) -> Column:
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return F.abs(F.col(head) - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))

    scores = [z(h, r).alias(f"z_{h}") for h, r in zip(HEADS, total[1:])]
    best: set[int] = set()
    for head in HEADS:  # a fixed number of rows each
        rows = counts.select("word", *scores).orderBy(F.desc(f"z_{head}"), "word").limit(fit.words // 2).collect()
        best |= {r.word for r in rows}
    return np.sort(np.array(sorted(best), np.int64).view(np.uint64))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients by Newton's method; the last is the intercept, which is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge),
                               x.T @ (y - p) - ridge * weight)
        weight += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return weight


def fit_classifier(docs: DataFrame, labels: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, coefficients (head by input) and base log-odds of the two labels."""
    sample = shared.written(labelled_sample(docs, labels, fit), "labelled")
    vocabulary = telling_words(sample, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text"):
                    x = _inputs(part.column("text"), vocabulary)
                    rows = [r.tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(part.column(h) for h in HEADS)],
                                                     names=["x", *HEADS])

    table = sample.mapInArrow(run, "x binary, quality double, toxic double").toArrow()  # bounded by fit_rows
    size = len(SHAPE) + len(vocabulary)
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, size).astype(np.float64)
    weights, base = np.zeros((len(HEADS), size + 1)), np.zeros(len(HEADS))
    for k, head in enumerate(HEADS):
        y = table[head].to_numpy()
        if len(y) and 0 < y.sum() < len(y):
            weights[k] = _logistic(x, y, fit.penalty)
            base[k] = np.log(y.mean() / (1 - y.mean()))
    return vocabulary, weights, base


def evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, host, path and each label's log-odds by the classifier."""
    vocabulary, weights, base = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text"):
                    logit = _inputs(part.column("text"), vocabulary) @ weights[:, :-1].T + weights[:, -1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("host"), part.column("path"),
                         pa.array(logit[:, 0].astype(np.float64)), pa.array(logit[:, 1].astype(np.float64))],
                        names=["doc_id", "host", "path", *(f"{h}_logit" for h in HEADS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "host", "path", "text").mapInArrow(
        run, f"doc_id {kind}, host string, path string, quality_logit double, toxic_logit double")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(bounded / (1 - bounded))


def _strength(groups: DataFrame, rate: Column, prior: Column) -> float:
    """Pseudo-counts of a prior: prior * (1 - prior) / variance between groups, less 1.

    The variance is that of the groups' shares about the prior beyond what counting alone explains,
    weighted by size; groups of one document say nothing about it.
    """
    noise = prior * (1 - prior)
    row = groups.filter("n > 1").agg(
        F.sum(F.col("n") * (rate - prior) ** 2), F.sum(noise), F.sum("n"),
        F.sum(F.col("n") * noise)).first()
    if not row[2]:
        return 100.0
    between = max((row[0] - row[1]) / row[2], 1e-9)
    return float(min(max(row[3] / row[2] / between - 1, 1.0), 1e6))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """host, path and each label's shrunk share; also the global shares.

    One aggregate over the documents by path, with map-side combine; hosts and the global level are
    sums of that small table.
    """
    paths = shared.written(scored.groupBy("host", "path").agg(
        F.count("*").alias("n"), *[F.sum(f"{h}_soft").alias(h) for h in HEADS]), "paths")
    hosts = shared.written(paths.groupBy("host").agg(
        F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS]), "hosts")
    total = hosts.agg(F.sum("n"), *[F.sum(h) for h in HEADS]).first()
    share = {h: ((total[k + 1] or 0.0) + 0.5) / ((total[0] or 0) + 1.0) for k, h in enumerate(HEADS)}
    for h in HEADS:
        pull = _strength(hosts, F.col(h) / F.col("n"), F.lit(share[h]))
        hosts = hosts.withColumn(f"{h}_host", (F.col(h) + pull * share[h]) / (F.col("n") + pull))
    out = paths.join(hosts.select("host", *[f"{h}_host" for h in HEADS]), "host")
    for h in HEADS:
        pull = _strength(out, F.col(h) / F.col("n"), F.col(f"{h}_host"))
        out = out.withColumn(f"{h}_path", (F.col(h) + pull * F.col(f"{h}_host")) / (F.col("n") + pull))
    return out.select("host", "path", F.col("n").alias("path_documents"),
                      *[f"{h}_{level}" for h in HEADS for level in ("host", "path")]), share


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit: Fit = Fit()) -> DataFrame:
    """doc_id, site, classifier and site probabilities, posteriors and the verdict ``kept``."""
    sited = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                        F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    model = fit_classifier(sited, labels, fit)
    scored = shared.written(evidence(sited, model), "evidence")
    known = one_label_each(labels)
    soft = scored.join(known, "doc_id", "left").select(
        "host", "path", *[F.coalesce(h, _sigmoid(F.col(f"{h}_logit"))).alias(f"{h}_soft") for h in HEADS])
    sites, _ = site_posteriors(soft)
    base = dict(zip(HEADS, model[2].tolist()))
    out = scored.join(sites, ["host", "path"])
    for h in HEADS:
        out = out.withColumn(h, F.round(_sigmoid(_logit(F.col(f"{h}_path")) + F.col(f"{h}_logit") - base[h]), 6))
    return out.select(
        "doc_id", "host", "path", "path_documents",
        *[F.round(_sigmoid(F.col(f"{h}_logit")), 6).alias(f"{h}_classifier") for h in HEADS],
        *[F.round(f"{h}_{level}", 6).alias(f"{h}_{level}") for h in HEADS for level in ("host", "path")],
        *HEADS, ((F.col("quality") >= fit.threshold) & (F.col("toxic") < fit.threshold)).alias("kept"))


def of_documents(spark: SparkSession, docs_path: str, labels_path: str) -> DataFrame:
    """Documents carry no address: the source is the host, the language its section."""
    return classify(spark.read.parquet(docs_path), spark.read.parquet(labels_path),
                    F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang")))
