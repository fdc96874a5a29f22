"""Language-model scores: a causal self-attention model in numpy on subword ids.

Text is lower-cased (A-Z) and cut into words; each word gives subword ids, each text one end id. The
model gives the next id's class from the ids before it, and the id from its class:

    P(id | before) = softmax(log bigram(class | last id) + attention(before) W)[class]
                     * P(id | class, last id)

Frequent ids are classes of their own; the others are grouped by their neighbours inside frequent
words. Both bigrams are counted over every training text, for the ids that have a symbol of their
own; other ids share one symbol per class and follow their frequency there. The attention layer
learns what the bigrams miss: every task runs Adam over all ids of its own training texts, and the
tasks' weights are averaged.

Texts are trained on and scored in windows of ``window`` ids that overlap, so that ids are predicted
from at least ``window - stride`` ids before them; each id is a target once in every round, and is
scored once.

The base score is a smoothed word unigram over all training words. Words on a bounded list of
frequent ones are counted and looked up in the tasks; all others go by shuffle to their count and
back to their text, so no key is hot and no dictionary has to fit anywhere.

Defined cases: null and empty texts are one end id; a text of any length is scored whole; a null
doc_id counts as the text "", whose remainder is 0, so it is held out; rows that repeat a doc_id and
text count as often as they stand there; without training texts all counts are 0 and the weights
stay as they begin. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from expband.llm import blocks, piece_codec, shared


@dataclass(frozen=True)
class Model:
    symbols: int = 1024         #: ids with an embedding of their own, less two
    classes: int = 64
    groups: int = 16            #: classes that are not a single id
    width: int = 16
    window: int = 16
    stride: int = 12
    train_every: int = 1        #: windows of a text to one that is trained on; 1 takes all
    rounds: int = 2
    batch: int = 256
    rate: float = 0.01
    frequent_words: int = 200_000
    fold: int = 10              #: crc32(doc_id) modulo fold is 0: held out


#: Words whose ids a Python worker remembers besides the frequent ones.
REMEMBERED = 300_000
#: Bytes of ids that are worked on at a time.
ID_BYTES = 3 << 19
#: Windows scored at a time; their arrays fit a core's cache.
BATCH_WINDOWS = 512


@dataclass
class Tables:
    """Bounded by the model's parameters and the vocabulary; sent to every task."""

    model: Model
    proto: bytes                                    #: the subword model
    words: np.ndarray                               #: sorted hashes of the frequent words
    word_ids: np.ndarray                            #: their ids, joined,
    word_at: np.ndarray                             #: and where each word's begin
    end: int
    symbol: np.ndarray                              #: by id
    group: np.ndarray                               #: class by id
    column: np.ndarray                              #: by id: its symbol, or that of its class's other ids
    bigram: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))   #: log P(class | symbol)
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))     #: log P(column | class, symbol)
    alone: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))    #: log P(id | column)
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


def prepared(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, text_mark and whether the row is for training."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", F.hash(F.coalesce("text", F.lit(""))).alias("text_mark"),
                       (F.crc32(name) % model.fold != 0).alias("train"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, blocks.Words, np.ndarray]]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in blocks.slices(batch, "text", 1 << 21):
                words = blocks.Words(part.column("text"), lower=True)
                yield part, words, words.hashes()


def frequent_words(rows: DataFrame, model: Model) -> list[str]:
    """Frequent words; the list only decides which words are counted in the tasks."""
    most = max(16, model.frequent_words // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, hashes in _parts(batches):
            _, first, n = np.unique(hashes, return_index=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[:most]
            top = top[words.end[first[top]] - words.start[first[top]] <= 64]
            text = [words.raw[words.start[i]:words.end[i]].tobytes().decode() for i in first[top]]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(n[top].astype(np.int64))],
                                             names=["word", "n"])

    counts = rows.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(model.frequent_words).collect()]


def start_tables(words: list[str], model_file: str, model: Model) -> Tables:
    """Ids of the frequent words, and symbols and classes from how they stand in them."""
    import sentencepiece

    with open(model_file, "rb") as f:
        proto = f.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=proto)
    size, end = pieces.get_piece_size(), pieces.eos_id()
    with np.errstate(over="ignore"):
        column = pa.array(words, pa.string())
        hashes = blocks.Words(column).hashes() if words else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    ids = pieces.encode([words[i] for i in order], num_threads=1) if words else []
    at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    flat = np.array([i for x in ids for i in x], np.int64)
    # Words are listed by count, so a word's share falls about as 1 / (place + 1).
    weight = np.repeat(1.0 / (order + 10.0), np.diff(at)) if words else np.zeros(0)
    mass = np.bincount(flat, weights=weight, minlength=size)
    mass[end] = mass.sum() + 1
    ranked = np.argsort(-mass, kind="stable")
    symbol = np.zeros(size, np.int64)               # 0: other ids; the last one stands before a text
    own = ranked[:model.symbols - 2]
    symbol[own] = np.arange(1, len(own) + 1)
    single = ranked[:model.classes - model.groups]
    group = np.full(size, -1)
    group[single] = np.arange(len(single))
    place = np.full(size, len(single))
    place[single] = np.arange(len(single))
    # An id's neighbours inside words: which frequent id stands before and after it.
    kinds = len(single) + 2
    near = np.zeros((size, 2 * kinds), np.float32)
    starts = np.zeros(len(flat) + 1, dtype=bool)
    starts[at] = True
    before = np.where(starts[:-1], kinds - 1, np.concatenate(([0], place[flat[:-1]])) if len(flat) else 0)
    after = np.where(starts[1:], kinds - 1, np.concatenate((place[flat[1:]], [0])) if len(flat) else 0)
    np.add.at(near, (flat, before), weight)
    np.add.at(near, (flat, kinds + after), weight)
    rest = np.flatnonzero(group < 0)
    share = near[rest] / np.maximum(near[rest].sum(1, keepdims=True), 1e-12)
    share = np.sqrt(share)
    centres = share[np.argsort(-mass[rest], kind="stable")[:model.groups]].copy()
    for _ in range(12):
        nearest = (share @ centres.T * 2 - (centres ** 2).sum(1)).argmax(1)
        for k in range(len(centres)):
            if (nearest == k).any():
                centres[k] = np.average(share[nearest == k], axis=0, weights=mass[rest][nearest == k] + 1e-9)
    group[rest] = len(single) + nearest
    column = np.where(symbol > 0, symbol, model.symbols + group)
    return Tables(model, proto, hashes[order], flat, at, end, symbol, group, column, theta=_begin(model))


_MEMORY: dict[int, bytes] = {}   # ids by word hash; kept from task to task, as they depend on the word alone
_MEMORY_OF: list[int] = []


class Subwords:
    """Turns the words of a slice into one sequence of ids; made once per task."""

    def __init__(self, tables: Tables):
        import sentencepiece

        self.t, self.known = tables, _MEMORY
        if _MEMORY_OF != [hash(tables.proto)]:
            _MEMORY.clear()
            _MEMORY_OF[:] = [hash(tables.proto)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=tables.proto)

    def _others(self, keys: list[int], words: blocks.Words, first: np.ndarray) -> list[bytes]:
        """Ids of words that are not listed; a bounded number of them is remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        raw, at = words.raw, first[new]
        texts = [raw[a:b].tobytes().decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
        for k, ids in zip(new, self.pieces.encode(texts, num_threads=1) if texts else []):
            self.known[keys[k]] = np.array(ids, "<i4").tobytes()
        return [self.known[key] for key in keys]

    def of(self, words: blocks.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows' ids, each row's closed by the end id, the rows + 1 offsets, and each word's place
        in the list of frequent words, or -1."""
        t = self.t
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        listed = np.minimum(np.searchsorted(t.words, kinds), max(len(t.words) - 1, 0))
        hit = t.words[listed] == kinds if len(t.words) else np.zeros(len(kinds), dtype=bool)
        other = self._others(kinds[~hit].tolist(), words, first[~hit])
        size = np.zeros(len(kinds), np.int64)
        size[hit] = np.diff(t.word_at)[listed[hit]] if len(t.words) else 0
        size[~hit] = np.fromiter(map(len, other), np.int64, len(other)) // 4
        at = np.zeros(len(kinds), np.int64)
        at[hit] = t.word_at[listed[hit]] if len(t.words) else 0
        at[~hit] = len(t.word_ids) + np.concatenate(([0], np.cumsum(size[~hit])))[:-1] if len(other) else 0
        store = np.concatenate((t.word_ids, np.frombuffer(b"".join(other), "<i4")))
        length = size[back]
        ends = np.concatenate(([0], np.cumsum(length)))
        flat = store[np.repeat(at[back] - ends[:-1], length) + np.arange(ends[-1])]
        rows = np.diff(ends[words.first]) + 1
        offsets = np.concatenate(([0], np.cumsum(rows)))
        out = np.full(offsets[-1], t.end, np.int64)
        inner = np.ones(len(out), dtype=bool)
        inner[offsets[1:] - 1] = False
        out[inner] = flat
        return out, offsets, np.where(hit, listed, -1)[back]


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's values as bytes; offsets are those of rows + 1."""
    ends = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The joined values of a column of ``_packed``, and the rows + 1 offsets."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]].view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def _id_kind(tables: Tables) -> type:
    return np.uint16 if len(tables.symbol) <= 1 << 16 else np.uint32


def encoded(rows: DataFrame, tables: Tables) -> DataFrame:
    """Every whole text cut once, written for all later steps: doc_id, text_mark, train, and as bytes its
    ids, its words' places in the list of frequent words (or -1), and the hash and number of each other word."""
    kind = _id_kind(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(tables)
        for part, words, hashes in _parts(batches):
            ids, offsets, listed = subwords.of(words, hashes)
            key, row = hashes[listed < 0], words.row[listed < 0]
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(fresh)
            others = np.searchsorted(row[at], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_mark"), part.column("train"), _packed(ids.astype(kind), offsets),
                 _packed(listed.astype(np.int32), words.first), _packed(key[at], others),
                 _packed(np.diff(np.append(at, len(key))).astype(np.int32), others)],
                names=["doc_id", "text_mark", "train", "ids", "listed", "others", "others_n"])

    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    return shared.written(rows.mapInArrow(run, f"doc_id {kind_of_id}, text_mark int, train boolean, ids binary, "
                                               "listed binary, others binary, others_n binary"), "ids", "zstd")


def _texts(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of encoded rows, their ids joined, and the rows + 1 offsets."""
    for batch in batches:
        for part in blocks.slices(batch, "ids", ID_BYTES):
            ids, offsets = _unpacked(part.column("ids"), kind)
            yield part, ids, offsets


def count(texts: DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all training texts: frequent words, ends and tokens; ids; pairs of symbol and column."""
    m, n_ids, k, kind = tables.model, len(tables.symbol), len(tables.words), _id_kind(tables)
    columns = m.symbols + m.classes
    sizes = [k + 2, n_ids, m.symbols * columns]
    borders = np.concatenate(([0], np.cumsum(sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_n, ids_n, pairs_n = (np.zeros(n, np.int64) for n in sizes)
        for part, ids, offsets in _texts(batches, kind):
            listed, _ = _unpacked(part.column("listed"), np.int32)
            words_n[:k] += np.bincount(listed[listed >= 0], minlength=k)[:k]
            words_n[k] += part.num_rows                     # ends
            words_n[k + 1] += len(listed) + part.num_rows   # tokens
            ids_n += np.bincount(ids, minlength=n_ids)
            last = np.concatenate(([0], tables.symbol[ids[:-1]]))
            last[offsets[:-1]] = m.symbols - 1
            pairs_n += np.bincount(last * columns + tables.column[ids], minlength=sizes[2])
        total = np.concatenate((words_n, ids_n, pairs_n))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000]), pa.array(total[at[i:i + 100_000]])],
                                             names=["at", "n"])

    sums = (texts.filter("train").select("ids", "listed").mapInArrow(run, "at bigint, n bigint")
            .groupBy("at").agg(F.sum("n").alias("n"))).toArrow()   # bounded by the model's parameters
    total = np.zeros(borders[-1], np.int64)
    total[sums["at"].to_numpy()] = sums["n"].to_numpy()
    words_n, ids_n, pairs_n = np.split(total, borders[1:-1])
    return words_n, ids_n, pairs_n.reshape(m.symbols, columns)


def _shapes(m: Model) -> list[tuple[int, ...]]:
    return [(m.symbols, m.width), (m.window, m.width), (m.width, 3 * m.width), (m.width, m.classes)]


def _split(theta: np.ndarray, m: Model) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes(m):
        n = math.prod(shape)
        out.append(theta[at:at + n].reshape(shape))
        at += n
    return out


def _begin(m: Model) -> np.ndarray:
    """First weights; the last matrix is 0, so the model begins as its bigrams."""
    rng = np.random.default_rng(20)
    parts = [rng.normal(0, 0.3, s) for s in _shapes(m)]
    parts[-1][:] = 0
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


class Space:
    """Arrays that are filled anew from batch to batch; fresh ones cost more than the arithmetic on them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        size, held = math.prod(shape), self.held.get(name)
        if held is None or held.size < size or held.dtype != dtype:
            held = self.held[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)


@lru_cache(maxsize=4)
def _allowed(t: int, kind: np.dtype) -> np.ndarray:
    """Upper bounds of attention logits, which win over the lower one: later places get no weight, and a
    place always sees itself, so no maximum is needed."""
    return np.where(np.tri(t, dtype=bool), 60.0, -1e9).astype(kind)


def _attend(symbols: np.ndarray, weights: list[np.ndarray], space: Space | None = None) -> tuple[np.ndarray, ...]:
    """Hidden states of a batch of windows, each place seeing itself and those before it; then what the
    gradient needs: inputs, the same transposed, inputs times both key matrices, attention and what it takes
    together. All of them are overwritten when the space is used again."""
    embed, place, qkv, _ = weights
    space = space or Space()
    (n, t), d, kind = symbols.shape, embed.shape[1], embed.dtype
    x = np.take(embed, symbols, axis=0, out=space("x", (n, t, d), kind), mode="clip")
    x += place
    flat = x.reshape(-1, d)
    turned = space("turned", (n, d, t), kind)
    turned[:] = x.transpose(0, 2, 1)
    joint = qkv[:, :d] @ qkv[:, d:2 * d].T * kind.type(d ** -0.5)
    g = np.matmul(flat, joint, out=space("g", (n * t, d), kind)).reshape(n, t, d)
    a = np.matmul(g, turned, out=space("a", (n, t, t), kind))
    np.clip(a, -60, _allowed(t, kind), out=a)
    np.exp(a, out=a)
    a *= (1 / (a.reshape(-1, t) @ np.ones(t, kind))).reshape(n, t, 1)
    c = np.matmul(a, x, out=space("c", (n, t, d), kind))
    h = np.matmul(c.reshape(-1, d), qkv[:, 2 * d:], out=space("h", (n * t, d), kind))
    h += flat
    return h.reshape(n, t, d), x, turned, g, a, c


def _weighed(h: np.ndarray, out: np.ndarray, before: np.ndarray, chance: np.ndarray, space: Space,
             cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes' weights after hidden states, their sums, and the logits in flat cells; ``chance`` is exp(bigram)."""
    shape = len(h), out.shape[1]
    e = np.matmul(h, out, out=space("e", shape, h.dtype))
    # No logit is above 60 unless a row's and a column's length allow it.
    if ((h * h) @ np.ones(h.shape[1], h.dtype)).max(initial=0) * (out * out).sum(0).max() > 3600:
        np.clip(e, -60, 60, out=e)
    hit = e.ravel().take(cell)
    np.exp(e, out=e)
    e *= np.take(chance, before, axis=0, out=space("chance", shape, chance.dtype), mode="clip")
    return e, e @ np.ones(shape[1], e.dtype), hit


def _step(symbols: np.ndarray, targets: np.ndarray, mask: np.ndarray, tables: Tables, theta: np.ndarray,
          chance: np.ndarray | None = None, space: Space | None = None) -> np.ndarray:
    """Gradient of the mean loss over the masked places of a batch."""
    m, space = tables.model, space or Space()
    chance = np.exp(tables.bigram) if chance is None else chance
    weights = _split(theta, m)
    _, _, qkv, out = weights
    h, x, turned, g, a, c = _attend(symbols, weights, space)
    (n, t, d), flat, c, kind = x.shape, x.reshape(-1, m.width), c.reshape(-1, m.width), x.dtype
    q, k, v, scale = qkv[:, :d], qkv[:, d:2 * d], qkv[:, 2 * d:], kind.type(d ** -0.5)
    at = np.flatnonzero(mask)                           # only these places have a loss
    h = np.take(h.reshape(-1, d), at, axis=0, out=space("wanted", (len(at), d), kind), mode="clip")
    cell = np.arange(len(at)) * m.classes + targets.ravel().take(at)
    e, total, _ = _weighed(h, out, symbols.ravel().take(at), chance, space, cell)
    e.reshape(-1)[cell] -= total
    part = (1 / (total * max(len(at), 1)))[:, None]     # e * part is the logits' gradient
    grad = np.zeros(len(theta), theta.dtype)
    d_embed, d_place, d_qkv, d_out = _split(grad, m)
    dh = space("dh", (n * t, d), kind)
    dh[:] = 0
    back = np.matmul(e, out.T, out=space("back", h.shape, kind))
    back *= part
    dh[at] = back
    h *= part
    d_out[:] = h.T @ e
    d_qkv[:, 2 * d:] = c.T @ dh
    dc = np.matmul(dh, v.T, out=space("dc", (n * t, d), kind))
    c *= dc
    ds = np.matmul(dc.reshape(n, t, d), turned, out=space("ds", (n, t, t), kind))
    ds -= (c @ np.ones(d, kind)).reshape(n, t, 1)
    ds *= a
    dg = np.matmul(ds, x, out=space("dg", (n, t, d), kind)).reshape(-1, d)
    joint = flat.T @ dg * scale
    d_qkv[:, :d] = joint @ k
    d_qkv[:, d:2 * d] = joint.T @ q
    dx = np.matmul(a.transpose(0, 2, 1), dc.reshape(n, t, d), out=space("dx", (n, t, d), kind))
    dx += np.matmul(ds.transpose(0, 2, 1), g, out=space("c", (n, t, d), kind))
    dx += dh.reshape(n, t, d)
    dx += np.matmul(dg, k @ q.T * scale, out=space("c", (n * t, d), kind)).reshape(n, t, d)
    d_place[:] = dx.sum(0)
    columns = space("columns", (d, n * t), np.dtype(np.float64))
    columns[:] = dx.reshape(-1, d).T
    for j in range(d):
        d_embed[:, j] = np.bincount(symbols.ravel(), weights=columns[j], minlength=m.symbols)
    return grad


def _laid(n: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Row and first place of the overlapping windows over rows of n ids."""
    windows = 1 + np.maximum(0, -(-(n - m.window) // m.stride))
    row = np.repeat(np.arange(len(n)), windows)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * m.stride


def _seen(row: np.ndarray, first: np.ndarray, symbols: np.ndarray, offsets: np.ndarray,
          m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows: where the ids to predict stand, the symbols before them, and which are wanted, so
    that each id of a row is wanted once."""
    place = np.arange(m.window)
    inner = first[:, None] + place                       # place in the text of the id to predict
    at = np.minimum(offsets[row][:, None] + inner, len(symbols) - 1)
    last = symbols[np.maximum(at - 1, 0)]
    last[inner == 0] = m.symbols - 1
    wanted = (inner < np.diff(offsets)[row][:, None]) & ((first == 0)[:, None] | (place >= m.window - m.stride))
    return at, last, wanted


def _targets(ids: np.ndarray, offsets: np.ndarray, marks: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, target classes and mask of the windows over all ids, as texts are scored."""
    m = t.model
    row, first = _laid(np.diff(offsets), m)
    if m.train_every > 1:
        turn = marks.astype(np.int64) % np.minimum(m.train_every, np.bincount(row))
        chosen = first // m.stride % m.train_every == turn[row]
        row, first = row[chosen], first[chosen]
    at, symbols, mask = _seen(row, first, t.symbol[ids], offsets, m)
    return symbols, t.group[ids[at]], mask


def _training_windows(part: pa.RecordBatch, words: blocks.Words, subwords: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The targets of a slice of texts."""
    ids, offsets, _ = subwords.of(words, words.hashes())
    return _targets(ids, offsets, part.column("text_mark").to_numpy(), subwords.t)


def train(texts: DataFrame, tables: Tables) -> np.ndarray:
    """Averaged weights after ``rounds`` passes of Adam in every task over its own windows."""
    m, kind = tables.model, _id_kind(tables)

    for turn in range(m.rounds):
        now = tables

        def run(batches: Iterator[pa.RecordBatch], now: Tables = now, turn: int = turn) -> Iterator[pa.RecordBatch]:
            theta, chance, space = now.theta.copy(), np.exp(now.bigram), Space()
            mean, square, step, seen = np.zeros_like(theta), np.zeros_like(theta), 0, 0
            rate = m.rate / (1 + 2 * turn)
            for part, ids, offsets in _texts(batches, kind):
                symbols, targets, mask = _targets(ids, offsets, part.column("text_mark").to_numpy(), now)
                order = np.random.default_rng(turn).permutation(len(symbols))
                for i in range(0, len(order), m.batch):
                    some = order[i:i + m.batch]
                    g = _step(symbols[some], targets[some], mask[some], now, theta, chance, space)
                    step, seen = step + 1, seen + len(some)
                    mean += 0.1 * (g - mean)
                    g *= g
                    square += 0.01 * (g - square)
                    theta -= mean * (rate / (1 - 0.9 ** step)) / (np.sqrt(square * (1 / (1 - 0.99 ** step))) + 1e-6)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(theta) + 1)), pa.array(np.append(theta, 1.0).astype(np.float64) * seen)],
                    names=["at", "v"])

        sums = (texts.filter("train").select("ids", "text_mark").mapInArrow(run, "at bigint, v double")
                .groupBy("at").agg(F.sum("v").alias("v"))).toArrow()   # one row per weight
        total = np.zeros(len(tables.theta) + 1)
        total[sums["at"].to_numpy()] = sums["v"].to_numpy()
        if total[-1]:
            tables.theta = (total[:-1] / total[-1]).astype(np.float32)
    return tables.theta


def _score(ids: np.ndarray, offsets: np.ndarray, tables: Tables, space: Space | None = None) -> np.ndarray:
    """log10 probability of each row's ids: overlapping windows, each id scored once."""
    m, n, space = tables.model, np.diff(offsets), space or Space()
    weights, chance = _split(tables.theta, m), np.exp(tables.bigram)
    symbols, groups = tables.symbol[ids], tables.group[ids]
    row, first = _laid(n, m)
    score = tables.alone[ids].astype(np.float64)
    before = np.concatenate(([0], symbols[:-1]))
    before[offsets[:-1]] = m.symbols - 1
    score += tables.pair[before, tables.column[ids]]
    score += tables.bigram[before, groups]
    for i in range(0, len(row), BATCH_WINDOWS):
        r, f = row[i:i + BATCH_WINDOWS], first[i:i + BATCH_WINDOWS]
        at, last, wanted = _seen(r, f, symbols, offsets, m)
        h = _attend(last, weights, space)[0]
        wanted = np.flatnonzero(wanted)
        there = at.ravel().take(wanted)
        h = np.take(h.reshape(-1, m.width), wanted, axis=0, out=space("wanted", (len(there), m.width), h.dtype), mode="clip")
        cell = np.arange(len(there)) * m.classes + groups.take(there)
        _, total, hit = _weighed(h, weights[3], before.take(there), chance, space, cell)
        score[there] += hit - np.log(total)
    return np.add.reduceat(score, offsets[:-1]) / np.log(10) if len(n) else np.zeros(0)


def fit(rows: DataFrame, model_file: str, model: Model) -> tuple[Tables, np.ndarray, DataFrame]:
    """The trained tables, the counts of the frequent words, ends and tokens, and the encoded texts."""
    tables = start_tables(frequent_words(rows, model), model_file, model)
    texts = encoded(rows, tables)
    words_n, ids_n, pairs_n = count(texts, tables)
    owner = np.zeros(pairs_n.shape[1], np.int64)            # the class of a column
    owner[tables.column] = tables.group
    owner[model.symbols:] = np.arange(model.classes)
    by_class = np.zeros((model.symbols, model.classes))
    for c in range(model.classes):
        by_class[:, c] = pairs_n[:, owner == c].sum(1)
    prior = (by_class.sum(0) + 0.5) / (by_class.sum() + 0.5 * model.classes)
    tables.bigram = np.log((by_class + 20.0 * prior) / (by_class.sum(1, keepdims=True) + 20.0)).astype(np.float32)
    used = np.bincount(tables.column, minlength=len(owner)) > 0
    seen = np.where(used, pairs_n.sum(0) + 0.1, 0.0)
    share = seen / np.maximum(np.bincount(owner, weights=seen, minlength=model.classes), 1e-9)[owner]
    pair = (pairs_n + 5.0 * share) / (by_class[:, owner] + 5.0)
    tables.pair = np.log(np.maximum(pair, 1e-30)).astype(np.float32)
    held = np.bincount(tables.column, weights=ids_n + 0.1, minlength=len(owner))
    tables.alone = np.log((ids_n + 0.1) / held[tables.column]).astype(np.float32)
    train(texts, tables)
    return tables, words_n, texts


def rare_words(texts: DataFrame) -> DataFrame:
    """word, doc_id, text_mark, n, n_train of the words that are not listed; one row per text and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            key, offsets = _unpacked(part.column("others"), np.uint64)
            n, _ = _unpacked(part.column("others_n"), np.int32)
            of = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            trained = part.column("train").to_numpy(zero_copy_only=False)[of]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks.signed(key)), part.column("doc_id").take(take), part.column("text_mark").take(take),
                 pa.array(n), pa.array(np.where(trained, n, 0).astype(np.int32))],
                names=["word", "doc_id", "text_mark", "n", "n_train"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return (texts.select("doc_id", "text_mark", "train", "others", "others_n")
            .mapInArrow(run, f"word bigint, doc_id {kind}, text_mark int, n int, n_train int"))


def score(docs: DataFrame, model_file: str, model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = prepared(shared.long_texts(docs), model)
    tables, counts, texts = fit(rows, model_file, model)
    k, ids_kind = len(tables.words), _id_kind(tables)
    known_words, log_words = counts[:k] > 0, np.log10(counts[:k] + 0.1)
    end_known, end_log = int(counts[k] > 0), float(np.log10(counts[k] + 0.1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for part, ids, offsets in _texts(batches, ids_kind):
            listed, at = _unpacked(part.column("listed"), np.int32)
            rows_n, words_n = part.num_rows, np.diff(at)
            row = np.repeat(np.arange(rows_n), words_n)
            known, logs = np.append(known_words, 0.0)[listed], np.append(log_words, 0.0)[listed]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_mark"), part.column("train"), pa.array(words_n + 1),
                 pa.array(np.bincount(row, weights=known, minlength=rows_n).astype(np.int64) + end_known),
                 pa.array(np.bincount(row, weights=logs, minlength=rows_n) + end_log),
                 pa.array(_score(ids, offsets, tables, space))],
                names=["doc_id", "text_mark", "train", "n_tokens", "known", "logs", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = (texts.select("doc_id", "text_mark", "train", "ids", "listed")
              .mapInArrow(run, f"doc_id {kind}, text_mark int, train boolean, n_tokens bigint, known bigint, "
                               "logs double, score double"))
    # Other words: to their count, then back to their text.
    word = Window.partitionBy("word")
    counted = (rare_words(texts)
               .withColumn("c", F.sum("n_train").over(word))
               .withColumn("first", F.row_number().over(word.orderBy("doc_id", "text_mark")) == 1))
    back = shared.written(counted.groupBy("doc_id", "text_mark").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("rare_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(F.col("first") & (F.col("c") > 0), 1).otherwise(0)).alias("distinct_words")), "rare")
    distinct = int(known_words.sum()) + end_known + int(back.agg(F.sum("distinct_words")).first()[0] or 0)
    tokens = int(counts[k + 1])
    bottom = float(np.log10(tokens + 0.1 * (distinct + 1)))
    back = back.select(F.col("doc_id").alias("id"), F.col("text_mark").alias("mark"), "rare_logs", "rare_known")
    # Rows that repeat a doc_id and text have been summed up together.
    alike = F.count("*").over(Window.partitionBy("doc_id", "text_mark"))
    both = scored.withColumn("alike", alike).join(
        back, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_mark") == F.col("mark")), "left")
    return both.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce(F.col("rare_known") / F.col("alike"), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce(F.col("rare_logs") / F.col("alike"), F.lit(0.0))
         - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), "score")


def of_documents(spark: SparkSession, path: str) -> DataFrame:
    return score(spark.read.parquet(path).select("doc_id", "text"), piece_codec.default_model())
