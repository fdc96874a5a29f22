"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Model: each token (lower-cased runs of letters and digits, or runs of other non-space characters)
is hashed by the engine (``xxhash64``, JVM-side) into ``buckets`` embedding rows of ``dim`` numbers.
Filters of several widths slide over the whole token sequence of a text; ReLU, max pooling over all
positions, and one logistic unit give a raw logit. Training is Adagrad on the weighted log loss
(classes balanced) with the exact gradient of max pooling: only the arg-max window of each filter and
text receives one, so a step costs the forward pass and a gather.

Calibration by language: the language of a text is not an input (nor its labels, source or doc_id);
it is detected from the text by a multinomial naive Bayes over hashed tokens whose counts the engine
aggregates over all training rows (``lang`` is the target of that detector, never an input of a
score). For each detected language a Platt pair (slope, offset) maps the raw logit to the score,
fitted on a calibration fifth of the labelled rows and drawn towards the all-language pair by a ridge
penalty, so the cut at 0.5 is a threshold per language.

Rows: labels come only from rows whose ``crc32(doc_id as text) % 5 != 0``. The fit reads every
labelled training row, whole texts: shards of ``shard_rows`` rows train side by side and are averaged
after each epoch. Tokens are packed before their first shuffle and dealt to the shards once, not once an
epoch; a task adds up the weights of its shards before they are sent. The detector's counts cover every training row; scoring covers every row.

Defined cases: a null or empty text is scored from its padding alone (a fixed score); a null doc_id is
never trained on and has ``held_out`` false; repeated rows are scored each, and labels that repeat a
doc_id count as toxic if any says so; very long texts are scored in blocks of positions with a
running maximum, so memory stays bounded; extra input columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.llm import shared

TOKENS = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 17
    dim: int = 16
    widths: tuple = (1, 2, 3)
    filters: int = 32
    epochs: int = 4
    batch: int = 32
    rate: float = 0.05
    seed: int = 7
    #: Labelled rows of one shard: a task trains on its shard for one epoch, then shards are averaged.
    shard_rows: int = 20_000
    #: Buckets of the language detector.
    lang_buckets: int = 1 << 14
    #: Ridge that draws a language's Platt pair towards the pair of all languages.
    calib_ridge: float = 20.0
    #: Positions of text forwarded at a time when scoring.
    block: int = 1 << 16


def hashed(docs: DataFrame) -> DataFrame:
    """Adds ``toks`` (array<long>): hashes of the tokens of the whole lower-cased text, JVM-side."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("toks", F.transform(F.regexp_extract_all(text, F.lit(TOKENS), 0), lambda w: F.xxhash64(w)))


def _bits(cfg: Config) -> int:
    """Bits of a token's hash that both bucket counts need."""
    return (math.lcm(cfg.buckets, cfg.lang_buckets) - 1).bit_length()


def pack(toks: np.ndarray, bits: int) -> bytes:
    """Numbers below ``2 ** bits`` as two-byte words and planes of the bits above, compressed."""
    planes = [np.packbits((toks >> k & 1).astype(np.uint8)) for k in range(16, bits)]
    parts = [np.array([len(toks)], "<i8"), (toks & 0xFFFF).astype("<u2"), *planes]
    return zlib.compress(b"".join(x.tobytes() for x in parts), 1)


def unpack(data: bytes, bits: int) -> np.ndarray:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    toks, at, size = np.frombuffer(raw, "<u2", n, 8).astype(np.int64), 8 + 2 * n, -(-n // 8)
    for k in range(16, bits):
        toks |= np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n).astype(np.int64) << k
        at += size
    return toks


def packed(rows: DataFrame, cfg: Config) -> DataFrame:
    """``doc_id, toks`` with the hashes reduced to both bucket counts and packed: under a quarter of the bytes."""
    both, bits = math.lcm(cfg.buckets, cfg.lang_buckets), _bits(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column("toks")
            values, at = toks.values.to_numpy() % both, toks.offsets.to_pylist()
            out = [pack(values[a:b], bits) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())],
                                             names=["doc_id", "toks"])

    return shared.long_texts(rows.select("doc_id", "toks")).mapInArrow(run, "doc_id long, toks binary")


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


# ----------------------------------------------------------------------------------------------- network

class Net:
    """Embeddings, filters of several widths, max pooling, one logistic unit; numpy arrays only."""

    def __init__(self, cfg: Config, params: dict | None = None):
        self.cfg = cfg
        if params is None:
            rng = np.random.default_rng(cfg.seed)
            params = {"emb": (rng.standard_normal((cfg.buckets + 1, cfg.dim)) * 0.1).astype(np.float32)}
            params["emb"][0] = 0  # row 0 pads
            for w in cfg.widths:
                params[f"w{w}"] = (rng.standard_normal((w, cfg.dim, cfg.filters)) * (1 / np.sqrt(w * cfg.dim))).astype(np.float32)
                params[f"b{w}"] = np.full(cfg.filters, 0.01, np.float32)  # off the kink of empty texts
            params["u"] = np.zeros(cfg.filters * len(cfg.widths), np.float32)
            params["c"] = np.zeros(1, np.float32)
        self.p = params

    def ids(self, toks) -> np.ndarray:
        return (np.asarray(toks, dtype=np.int64) % self.cfg.buckets + 1).astype(np.int64)

    def _layout(self, docs: list[np.ndarray]):
        """Concatenates the texts, each followed by max(widths) pads, and the first position of each."""
        pad = max(self.cfg.widths)
        lengths = np.array([len(d) + pad for d in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        seq = np.zeros(int(lengths.sum()) + pad, np.int64)
        for s, d in zip(starts, docs):
            seq[s:s + len(d)] = d
        return seq, starts, lengths

    def _taps(self) -> list[tuple[int, np.ndarray]]:
        """Per place in a window: the first filter that reaches it, and the weights there of it and all after."""
        widths, f = self.cfg.widths, self.cfg.filters
        if list(widths) != sorted(widths):
            raise ValueError("widths must ascend")
        reach = [[i for i, w in enumerate(widths) if w > k] for k in range(max(widths))]
        return [(of[0] * f, np.concatenate([self.p[f"w{widths[i]}"][k].T for i in of])) for k, of in enumerate(reach)]

    def _top(self, doc: np.ndarray, taps: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest value over a text, before bias and ReLU, and the first window start that has it.

        Filters are rows, so both run along the text; long texts go block by block with a running maximum.
        """
        pad, block, f = max(self.cfg.widths), self.cfg.block, self.cfg.filters
        n = len(doc) + pad
        seq = np.concatenate([doc, np.zeros(2 * pad, np.int64)])
        best, arg = np.full(f * len(self.cfg.widths), -np.inf, taps[0][1].dtype), np.zeros(f * len(self.cfg.widths), np.int64)
        for a in range(0, n, block):
            m = min(block, n - a)
            emb = self.p["emb"][seq[a:a + m + pad]].T
            h = taps[0][1] @ emb[:, :m]
            for k, (first, w) in enumerate(taps[1:], 1):
                h[first:] += w @ emb[:, k:k + m]
            for i, w in enumerate(self.cfg.widths):
                stop = min(m, n - w + 1 - a)
                if stop <= 0:
                    continue
                part, own = h[i * f:(i + 1) * f, :stop], slice(i * f, (i + 1) * f)
                at = part.argmax(axis=1)
                top = part[np.arange(f), at]
                more = top > best[own]
                best[own] = np.where(more, top, best[own])
                arg[own] = np.where(more, a + at, arg[own])
        return best, arg

    def _bias(self) -> np.ndarray:
        return np.concatenate([self.p[f"b{w}"] for w in self.cfg.widths])

    def pooled(self, docs: list[np.ndarray], with_args: bool = False):
        """Max-pooled features of each text (and the arg-max position of each filter, for the gradient)."""
        taps, f = self._taps(), self.cfg.filters
        found = [self._top(d, taps) for d in docs]
        feats = np.maximum(np.stack([top for top, _ in found]) + self._bias(), 0)
        if not with_args:
            return feats, None, []
        seq, starts, _ = self._layout(docs)
        args = np.stack([at for _, at in found]) + starts[:, None]
        return feats, seq, [args[:, i * f:(i + 1) * f] for i in range(len(self.cfg.widths))]

    def logits(self, feats: np.ndarray) -> np.ndarray:
        return feats @ self.p["u"] + self.p["c"][0]

    def pooled_long(self, doc: np.ndarray) -> np.ndarray:
        """Pooled features of one text."""
        return np.maximum(self._top(doc, self._taps())[0] + self._bias(), 0)

    def features(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros((0, self.cfg.filters * len(self.cfg.widths)), np.float32)
        return self.pooled(docs)[0]

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray):
        """Weighted log loss of a batch, gradients of the dense weights, embedding rows and their gradients."""
        feats, seq, args = self.pooled(docs, with_args=True)
        z = self.logits(feats)
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(np.sum(weight * (np.logaddexp(0, z) - y * z)))
        dz = (weight * (prob - y)).astype(np.float32)
        grads = {"u": feats.T @ dz, "c": np.array([dz.sum()], np.float32)}
        dfeat = np.outer(dz, self.p["u"])
        emb_rows, emb_grads = [], []
        for i, w in enumerate(self.cfg.widths):
            f = self.cfg.filters
            dtop = dfeat[:, i * f:(i + 1) * f] * (feats[:, i * f:(i + 1) * f] > 0)  # ReLU
            pos = args[i]  # (texts, filters): window start of each filter's maximum
            gw = np.zeros_like(self.p[f"w{w}"])
            for k in range(w):
                e = self.p["emb"][seq[pos + k]]  # (texts, filters, dim)
                gw[k] = np.einsum("tfd,tf->df", e, dtop)
                emb_rows.append((seq[pos + k]).reshape(-1))
                emb_grads.append((dtop[:, :, None] * self.p[f"w{w}"][k].T[None, :, :]).reshape(-1, self.cfg.dim))
            grads[f"w{w}"] = gw
            grads[f"b{w}"] = dtop.sum(axis=0)
        rows = np.concatenate(emb_rows)
        uniq, inv = np.unique(rows, return_inverse=True)
        g = np.zeros((len(uniq), self.cfg.dim), np.float32)
        np.add.at(g, inv, np.concatenate(emb_grads))
        keep = uniq != 0
        return loss, grads, uniq[keep], g[keep]

    def step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, acc: dict) -> float:
        """One Adagrad step on the weighted log loss of a batch; returns the batch loss."""
        loss, grads, uniq, g = self.gradients(docs, y, weight)
        lr = self.cfg.rate
        acc_e = acc.setdefault("emb", np.full((self.cfg.buckets + 1, self.cfg.dim), 1e-6, np.float32))
        acc_e[uniq] += g * g
        self.p["emb"][uniq] -= lr * g / np.sqrt(acc_e[uniq])
        for name, gr in grads.items():
            a = acc.setdefault(name, np.full_like(self.p[name], 1e-6))
            a += gr * gr
            self.p[name] -= lr * gr / np.sqrt(a)
        return loss


def epoch(net: Net, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, acc: dict, turn: int) -> None:
    """One pass of Adagrad over the given texts (ids), in an order of its own."""
    order = np.random.default_rng((net.cfg.seed, turn)).permutation(len(docs))
    for a in range(0, len(order), net.cfg.batch):
        b = order[a:a + net.cfg.batch]
        net.step([docs[i] for i in b], y[b].astype(np.float32), weight[b] / net.cfg.batch, acc)


def _rows(p: np.ndarray, cfg: Config) -> np.ndarray:
    """Weights of any shape as rows of ``dim`` numbers, the last one filled up with zeros."""
    return np.pad(p.reshape(-1), (0, -p.size % cfg.dim)).reshape(-1, cfg.dim)


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """The rows with their ``shard``, moved to its task once and kept there on disk for all epochs.

    Tasks with rows are at most as many as cores, so the weights that leave them are bounded by the cluster and
    not by the table: a task's shards are added up by the partial aggregate behind them. A few shards get finer
    ranges, so that no two share a task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = cores if shards > cores else 4 * shards
    shard = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).alias("shard")
    return rows.select(shard, "key", "toks", "y").repartitionByRange(tasks, "shard").persist(StorageLevel.DISK_ONLY)


def fit_net(cfg: Config, rows: DataFrame) -> Net:
    """Trains on all ``key, toks (packed), y`` rows, with classes weighted to balance.

    Shards of about ``shard_rows`` rows train side by side for one epoch from the same weights and Adagrad
    sums; a weight is then averaged over the shards that changed it. One shard is plain Adagrad.
    """
    net, acc = Net(cfg), {}
    names = sorted(net.p)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total, pos = sum(sizes.values()), max(1, sizes.get(1, 0))
    if not total:
        return net
    neg = max(1, total - sizes.get(1, 0))
    shards = -(-total // cfg.shard_rows)
    mine_only, bits = dealt(rows, shards), _bits(cfg)
    for turn in range(cfg.epochs):
        sent = rows.sparkSession.sparkContext.broadcast((net.p, acc))  # sized by buckets and filters

        def train(pdf: pd.DataFrame) -> pd.DataFrame:
            before, sums = sent.value
            mine, own = Net(cfg, {k: v.copy() for k, v in before.items()}), {k: v.copy() for k, v in sums.items()}
            pdf = pdf.sort_values("key")
            y = pdf["y"].to_numpy()
            weight = np.where(y == 1, total / (2 * pos), total / (2 * neg)).astype(np.float32)
            epoch(mine, [mine.ids(unpack(t, bits)) for t in pdf["toks"]], y, weight, own, turn)
            out = []
            for k, name in enumerate(names):
                now = np.concatenate((_rows(mine.p[name], cfg), _rows(own[name], cfg)), axis=1)
                changed = np.flatnonzero((_rows(mine.p[name], cfg) != _rows(before[name], cfg)).any(axis=1))
                out.append(pd.DataFrame({"k": k, "i": changed, "v": list(now[changed])}))
            return pd.concat(out)

        moved = mine_only.groupBy("shard").applyInPandas(train, "k int, i int, v array<float>")
        mean = F.array(*[F.avg(F.get("v", j)) for j in range(2 * cfg.dim)]).cast("array<float>")
        got = moved.groupBy("k", "i").agg(mean.alias("v")).toArrow()   # at most one row per row of weights
        if not got.num_rows:
            continue
        of, places = got["k"].to_numpy(), got["i"].to_numpy()
        values = got["v"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * cfg.dim)
        for k, name in enumerate(names):
            at, v = places[of == k], values[of == k]
            size, shape = net.p[name].size, net.p[name].shape
            rows_p = _rows(net.p[name], cfg).copy()
            rows_a = _rows(acc.get(name, np.full(shape, 1e-6, np.float32)), cfg).copy()
            rows_p[at], rows_a[at] = v[:, :cfg.dim], v[:, cfg.dim:]
            net.p[name], acc[name] = (x.reshape(-1)[:size].reshape(shape) for x in (rows_p, rows_a))
        sent.destroy()
    mine_only.unpersist()
    return net


# ----------------------------------------------------------------------------------------- calibration

def platt(z: np.ndarray, y: np.ndarray, prior=(1.0, 0.0), ridge: float = 0.0, steps: int = 50, n=1.0) -> tuple:
    """Slope and offset of sigmoid(a z + b) by Newton's method, with a ridge towards ``prior``; ``n``: rows of each z."""
    a, b = prior
    if ridge == 0 and (len(y) == 0 or y.min() == y.max()):
        return float(a), float(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r = n * (p - y)
        s = n * np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum(r * z) + ridge * (a - prior[0]), np.sum(r) + ridge * (b - prior[1])])
        h = np.array([[np.sum(s * z * z) + ridge, np.sum(s * z)], [np.sum(s * z), np.sum(s) + ridge]]) + 1e-9 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def language_table(train: DataFrame, cfg: Config) -> tuple[list[str], np.ndarray]:
    """Log-probabilities of token buckets per language, from counts over all training rows."""
    counts = (train.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.explode("toks").alias("h"))
              .groupBy("lang", F.pmod(F.col("h"), F.lit(cfg.lang_buckets)).alias("bucket")).count())
    rows = counts.toPandas()  # at most languages x lang_buckets rows, by Arrow
    langs = sorted(rows["lang"].unique().tolist())
    if not langs:
        return [""], np.zeros((1, cfg.lang_buckets), np.float32)
    table = np.ones((len(langs), cfg.lang_buckets), np.float64)
    at = {lang: i for i, lang in enumerate(langs)}
    np.add.at(table, (rows["lang"].map(at).to_numpy(), rows["bucket"].to_numpy()), rows["count"].to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def detect(table: np.ndarray, toks, lang_buckets: int) -> int:
    b = np.asarray(toks, np.int64) % lang_buckets
    return int(np.argmax(table[:, b].sum(axis=1))) if len(b) else 0


# ------------------------------------------------------------------------------------------------- job

def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic label (1 if any label row says so) of the labels outside the held-out fifth."""
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y"))
    return flags.where(~held_out(F.col("doc_id")))


def labelled_rows(docs: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """key (doc_id), calib (a fifth by hash), toks (packed), y: one row for each training id, written to the shared folder.

    Only packed tokens are shuffled, never texts. Up to ``shared.BROADCAST_KEYS`` labelled ids are sent to the
    texts first, so that others are not packed. A doc_id that repeats keeps one row (by a partial aggregate, so
    a hot id costs one row a task).
    """
    flags = shared.written(training_labels(labels), "flags")
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    if flags.count() <= shared.BROADCAST_KEYS:
        texts = texts.join(F.broadcast(flags.select("doc_id")), "doc_id", "left_semi")
    rows = packed(hashed(texts), cfg).join(flags, "doc_id").dropDuplicates(["doc_id"])
    kept = rows.select(F.col("doc_id").alias("key"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calib"),
                       "toks", "y")
    return shared.written(kept, "toxic")


#: Places of a raw logit that calibration keeps, so that equal ones can be counted together.
PLACES = 3


def logit_counts(rows: DataFrame, net: Net, table: np.ndarray, cfg: Config) -> pd.DataFrame:
    """g (detected language), y, z, n: how many rows have the raw logit z, rounded and within 30; bounded by that."""
    sent, bits = rows.sparkSession.sparkContext.broadcast((net.p, table)), _bits(cfg)

    def run(batches):
        params, langs = sent.value
        net_ = Net(cfg, params)
        for pdf in batches:
            toks = [unpack(t, bits) for t in pdf["toks"]]
            z = net_.logits(net_.features([net_.ids(t) for t in toks])).astype(np.float64)
            yield pd.DataFrame({"g": [detect(langs, t, cfg.lang_buckets) for t in toks], "y": pdf["y"],
                                "z": np.round(np.clip(z, -30, 30), PLACES)})

    return (rows.select("toks", "y").mapInPandas(run, "g int, y int, z double")
            .groupBy("g", "y", "z").agg(F.count("*").alias("n")).toArrow().to_pandas())


def fit(docs: DataFrame, labels: DataFrame, cfg: Config = Config()) -> dict:
    """The network, the language detector and the Platt pairs, from all labelled training rows.

    The network learns from four fifths of them (by hash), the Platt pairs per detected language from the rest.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, table = language_table(hashed(docs.where(~held_out(F.col("doc_id")))), cfg)
    rows = labelled_rows(docs, labels, cfg)
    net = fit_net(cfg, rows.where(~F.col("calib")))
    calib = logit_counts(rows.where("calib"), net, table, cfg)
    if not len(calib):
        calib = logit_counts(rows, net, table, cfg)
    g, y, z, n = (calib[c].to_numpy() for c in ("g", "y", "z", "n"))
    y = y.astype(np.float64)
    whole = platt(z, y, n=n)
    pairs = np.array([platt(z[g == k], y[g == k], whole, cfg.calib_ridge, n=n[g == k]) if (g == k).any() else whole
                      for k in range(len(langs))], np.float64).reshape(len(langs), 2)
    return {"net": net.p, "langs": langs, "table": table, "pairs": pairs}


def score(docs: DataFrame, model: dict, cfg: Config = Config()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5) and the detected language, per row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # sized by buckets and filters, not by the data
    rows = hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "toks")

    def run(batches):
        m = shared.value
        net = Net(cfg, m["net"])
        for pdf in batches:
            toks = [np.asarray(t, np.int64) for t in pdf["toks"]]
            z = net.logits(net.features([net.ids(t) for t in toks]))
            g = np.array([detect(m["table"], t, cfg.lang_buckets) for t in toks], np.int64)
            a, b = m["pairs"][g, 0], m["pairs"][g, 1]
            s = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s.astype(np.float64),
                                "predicted": (s >= 0.5).astype(np.int32),
                                "detected_lang": [m["langs"][i] for i in g]})

    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, detected_lang string")


def of_documents(spark: SparkSession, documents: str, labels: str, cfg: Config = Config()) -> DataFrame:
    docs = spark.read.parquet(documents)
    return score(docs, fit(docs, spark.read.parquet(labels), cfg), cfg)
