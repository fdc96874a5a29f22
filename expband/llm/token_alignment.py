"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

A text is encoded by tokenizer A (byte-level BPE, of ``" " + text``) and by tokenizer B (SentencePiece,
which adds the space itself), both without special tokens: their strings inside a text are plain
text. Each token stands for bytes (A: its vocabulary entry, byte-level decoded; B: its piece in UTF-8,
U+2581 as a space, ``<0xHH>`` as the byte HH). Byte offsets where an A token and a B token both end
cut the two sequences into groups; the A and B tokens that end at such an offset form a link, and an
(A id, B id) pair's count is how many links of the whole corpus hold it.

Method, three passes over Spark:

1. *Align.* Each task aligns its texts and emits its distinct link pairs as 31-bit keys
   (``a * 32768 + b``) with their counts in that task; the table is written to the shared folder.
2. *Minimal perfect hash of the distinct pairs.* Keys are dealt into parts of about ``part_keys``
   by a 64-bit mix; each part builds, in one task, a hash-and-displace function (buckets of about
   four keys, largest first, each given the first seed that sends all its keys to free slots of a
   table of n / ``load`` slots) made minimal by the rank of occupied slots. Index = the part's offset
   + rank; the keys in index order are kept to verify every lookup.
3. *Count.* Each task adds its pairs into a dense vector indexed by the hash (after verifying the
   key), and the vectors are summed in a tree (``treeReduce``) into one count per distinct pair; the
   largest count of each B id marks its best pairs. The hash, the counts and the flags are broadcast
   only when the number of distinct pairs is at most ``max_pairs`` (about 13 bytes a pair); beyond,
   the same counts are summed by a shuffle aggregate and the lookups become a join.

A second pass then re-aligns every document and looks its links' counts up.

Result per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of
their B id, ties included), count_sum, and groups_sha256 (SHA-256 of ``a1,a2|b1;a3|b2,b3``; '' when
the row has no tokens). Defined cases: texts that are null, empty, or whose A or B bytes do not join
to ``" " + text`` have no tokens: zeros and ''. Repeated rows are aligned and counted each; very long
texts are aligned whole; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from expband.llm import shared

B_IDS = 32768  # B ids are below 2**15, so a pair is a * 32768 + b
#: Characters of the texts that are aligned as one sequence; a longer text is one by itself.
SLICE_CHARS = 1 << 17


@dataclass(frozen=True)
class Config:
    a_file: str = "byte_bpe_50k.json"
    #: The same vocabulary as ranks, for tiktoken.
    a_ranks: str = "byte_bpe_50k.tiktoken"
    b_file: str = "piece_bpe_32k.model"
    #: Keys of one part of the perfect hash (one task builds it).
    part_keys: int = 100_000
    #: Share of a part's slots that keys fill before the rank makes the hash minimal.
    load: float = 0.85
    #: Most distinct pairs whose hash, counts and flags are broadcast; beyond, joins by shuffle.
    max_pairs: int = 20_000_000


def tokenizer_files(cfg: Config) -> tuple[str, bytes, bytes, str]:
    """The tokenizer files and A's split pattern, read on the driver only (their place is a parameter)."""
    import public_tokenizers
    with open(public_tokenizers.path(cfg.a_file), encoding="utf-8") as f:
        a = f.read()
    with open(public_tokenizers.path(cfg.a_ranks), "rb") as f:
        ranks = f.read()
    with open(public_tokenizers.path(cfg.b_file), "rb") as f:
        b = f.read()
    return a, ranks, b, public_tokenizers.PATTERN


_LOADED: dict = {}


class Aligner:
    """Both tokenizers and the bytes of every id; built once per Python worker.

    A is run by tiktoken over the ranks of the same byte-level vocabulary (``a_ranks``), which gives
    the ids of the tokenizers library's ``a_file`` about six times faster (tests hold the two equal);
    an A token's bytes are its entry of ``a_file``, byte-level decoded, and equal its rank's bytes.
    """

    def __init__(self, a_json: str, a_ranks: bytes, b_model: bytes, pattern: str):
        import base64
        import json

        import sentencepiece
        import tiktoken
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, a_ranks.splitlines()) if x}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # byte-level alphabet: printable bytes stand for themselves, the others for 256 + k in order
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char_of = {b: chr(b) for b in keep}
        for k, b in enumerate(x for x in range(256) if x not in char_of):
            char_of[b] = chr(256 + k)
        byte_of = {c: b for b, c in char_of.items()}
        vocab = json.loads(a_json)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("\u2581", " ").encode("utf-8"))
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # all token bytes in one buffer, so that a sequence's bytes are one vectorised gather
        self.a_flat = np.frombuffer(b"".join(self.a_bytes), np.uint8)
        self.b_flat = np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.a_off = np.cumsum(self.a_len) - self.a_len
        self.b_off = np.cumsum(self.b_len) - self.b_len
        self.a_dec = np.array([str(i) for i in range(len(self.a_bytes))], object)
        self.b_dec = np.array([str(i) for i in range(len(self.b_bytes))], object)
        # decimal ids, each with room for its separator, in one buffer; the same for both vocabularies
        dec = [b"%d," % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.dec_flat = np.frombuffer(b"".join(dec), np.uint8)
        self.dec_len = np.array([len(x) for x in dec], np.int64)
        self.dec_off = np.cumsum(self.dec_len) - self.dec_len

    @staticmethod
    def of(files) -> "Aligner":
        key = id(files)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Aligner(*files)
        return _LOADED[key]

    def align(self, text: str | None):
        """A ids, B ids, and the indices of the A and B tokens that end together; None without tokens."""
        if not text:
            return None
        raw = (" " + text).encode("utf-8")
        a_list = self.a.encode_ordinary(" " + text)
        b_list = self.b.encode(text)
        if not a_list or not b_list:
            return None
        a, b = np.array(a_list, np.int64), np.array(b_list, np.int64)
        la, lb = self.a_len[a], self.b_len[b]
        ea, eb = np.cumsum(la), np.cumsum(lb)
        if ea[-1] != len(raw) or eb[-1] != len(raw):
            return None
        if (_gather(self.a_flat, self.a_off[a], la, ea) != raw
                or _gather(self.b_flat, self.b_off[b], lb, eb) != raw):
            return None
        _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
        return a, b, ia, ib

    def align_all(self, texts: list[str | None]) -> Iterator["Aligned"]:
        """``align`` of every text, in slices of about ``SLICE_CHARS`` characters worked on as one sequence."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE_CHARS):
                size += len(texts[end] or "")
                end += 1
            yield self._align_slice(texts[at:end])
            at = end

    def _align_slice(self, texts: list[str | None]) -> "Aligned":
        row = [i for i, t in enumerate(texts) if t]
        raw = [(" " + texts[i]).encode("utf-8") for i in row]
        a_ids = [self.a.encode_ordinary(" " + texts[i]) for i in row]
        b_ids = self.b.encode([texts[i] for i in row], num_threads=1) if row else []
        size, na, nb = (np.array([len(x) for x in part], np.int64) for part in (raw, a_ids, b_ids))
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum()))
                for ids, n in ((a_ids, na), (b_ids, nb)))
        # texts without tokens, or whose tokens' bytes are not as many as theirs, then those with other bytes
        good = (na > 0) & (nb > 0) & (_sums(self.a_len[a], na) == size) & (_sums(self.b_len[b], nb) == size)
        for again in (True, False):
            if not good.all():
                a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
                row, raw = [r for r, g in zip(row, good) if g], [x for x, g in zip(raw, good) if g]
                size, na, nb = size[good], na[good], nb[good]
            la, lb = self.a_len[a], self.b_len[b]
            ea, eb = np.cumsum(la), np.cumsum(lb)
            if again:
                whole = np.frombuffer(b"".join(raw), np.uint8)
                good = _sums((_gathered(self.a_flat, self.a_off[a], la, ea) != whole)
                             | (_gathered(self.b_flat, self.b_off[b], lb, eb) != whole), size) == 0
        ends = np.zeros(int(size.sum()) + 1, np.uint8)
        ends[ea] = 1
        ends[eb] += 2
        return Aligned(self, len(texts), np.array(row, np.int64), a, b, na, nb, ends[ea] == 3, ends[eb] == 3)

    def groups_text(self, a, b, ia, ib) -> str:
        """``a1,a2|b1;a3|b2,b3``: per group its A ids, then its B ids, in order."""
        ka = np.searchsorted(ia, np.arange(len(a))) * 2
        kb = np.searchsorted(ib, np.arange(len(b))) * 2 + 1
        words = np.concatenate([self.a_dec[a], self.b_dec[b]])
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[ia], last_b[ib] = True, True
        seps = np.concatenate([np.where(last_a, "|", ","), np.where(last_b, ";", ",")]).astype(object)
        order = np.argsort(np.concatenate([ka, kb]), kind="stable")
        out = np.empty(2 * len(order), object)
        out[0::2], out[1::2] = words[order], seps[order]
        return "".join(out.tolist())[:-1]


def _gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of a token sequence: ``flat[starts[k]:starts[k] + lens[k]]`` joined over ``k``."""
    pos = np.repeat(starts - (ends - lens), lens)
    pos += np.arange(len(pos))
    return flat[pos]


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, ends: np.ndarray) -> bytes:
    return _gathered(flat, starts, lens, ends).tobytes()


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of ``n`` values; a part may be empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


@dataclass
class Aligned:
    """Texts aligned as one sequence. Every text with tokens ends with a link, so groups never cross texts."""

    al: Aligner
    texts: int
    row: np.ndarray         #: which texts have tokens, in order
    a: np.ndarray
    b: np.ndarray
    na: np.ndarray          #: A tokens of each text with tokens
    nb: np.ndarray
    a_last: np.ndarray      #: by token: it ends where a token of the other side ends
    b_last: np.ndarray

    @property
    def links(self) -> np.ndarray:
        """How many links each text with tokens has."""
        return _sums(self.a_last, self.na)

    def keys(self) -> np.ndarray:
        return self.a[self.a_last] * B_IDS + self.b[self.b_last]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the texts with tokens as those of all texts, 0 for the others."""
        out = np.zeros(self.texts, np.int64)
        out[self.row] = values
        return out

    def digests(self) -> list[str]:
        """SHA-256 of each text's ``groups_text``; '' without tokens."""
        out = [""] * self.texts
        if not len(self.row):
            return out
        al, a_end, b_end = self.al, np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1
        # places in the merged order: a group's A tokens stand after the B tokens of the groups before it
        at_a = np.arange(len(self.a)) + np.concatenate(([0], b_end))[np.cumsum(self.a_last) - self.a_last]
        at_b = np.arange(len(self.b)) + a_end[np.cumsum(self.b_last) - self.b_last]
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        lens = al.dec_len[ids]
        ends = np.cumsum(lens)
        text = _gathered(al.dec_flat, al.dec_off[ids], lens, ends)
        text[ends[at_a[self.a_last]] - 1] = ord("|")
        text[ends[at_b[self.b_last]] - 1] = ord(";")
        stop = ends[np.cumsum(self.na + self.nb) - 1]
        view = memoryview(text)
        for r, start, end in zip(self.row.tolist(), [0, *stop[:-1].tolist()], stop.tolist()):
            out[r] = hashlib.sha256(view[start:end - 1]).hexdigest()
        return out


# ------------------------------------------------------------------------------------ perfect hash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x) -> np.ndarray:
    """splitmix64 finaliser over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + M1
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))


def part_of(keys, parts: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _slots(keys: np.ndarray, seed, m: int) -> np.ndarray:
    return (mix(np.asarray(keys, np.uint64) ^ mix(np.asarray(seed, np.uint64) + np.uint64(1))) % np.uint64(m)).astype(np.int64)


def build_part(keys: np.ndarray, load: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds per bucket, rank per slot and keys in index order of one part's hash-and-displace function."""
    keys = np.unique(np.asarray(keys, np.int64))
    n = len(keys)
    m = max(1, math.ceil(n / load))
    nb = max(1, math.ceil(n / 4))
    bucket = (mix(keys) % np.uint64(nb)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(nb + 1))
    sizes = np.diff(bounds)
    seeds = np.zeros(nb, np.int64)
    free = np.ones(m, bool)
    for g in np.argsort(-sizes, kind="stable"):
        if sizes[g] == 0:
            break
        mine = keys[order[bounds[g]:bounds[g + 1]]]
        d = 0
        while True:
            s = _slots(mine, d, m)
            if free[s].all() and len(np.unique(s)) == len(s):
                free[s] = False
                seeds[g] = d
                break
            d += 1
    rank = np.cumsum(~free) - 1
    index = rank[_slots(keys, seeds[bucket], m)]
    in_order = np.empty(n, np.int64)
    in_order[index] = keys
    return seeds, rank.astype(np.int64), in_order


class Hash:
    """The parts of the minimal perfect hash as flat arrays; ``index`` verifies every key."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], n_parts: int):
        got = {p: (s, r, k) for p, s, r, k in parts}
        empty = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
        cols = [got.get(p, empty) for p in range(n_parts)]
        self.n_parts = n_parts
        self.nb = np.array([len(s) for s, _, _ in cols], np.int64)
        self.m = np.array([len(r) for _, r, _ in cols], np.int64)
        self.seed_at = np.concatenate([[0], np.cumsum(self.nb)[:-1]])
        self.slot_at = np.concatenate([[0], np.cumsum(self.m)[:-1]])
        self.key_at = np.concatenate([[0], np.cumsum([len(k) for _, _, k in cols])[:-1]])
        self.seeds = np.concatenate([s for s, _, _ in cols])
        self.rank = np.concatenate([r for _, r, _ in cols])
        self.keys = np.concatenate([k for _, _, k in cols])

    def __len__(self):
        return len(self.keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1 for keys that are not in the set."""
        keys = np.asarray(keys, np.int64)
        if len(keys) == 0 or len(self.keys) == 0:
            return np.full(len(keys), -1, np.int64)
        p = part_of(keys, self.n_parts)
        b = (mix(keys) % self.nb[p].astype(np.uint64)).astype(np.int64)
        s = (mix(keys.astype(np.uint64) ^ mix(self.seeds[self.seed_at[p] + b].astype(np.uint64) + np.uint64(1)))
             % self.m[p].astype(np.uint64)).astype(np.int64)
        i = self.key_at[p] + self.rank[self.slot_at[p] + s]
        i = np.clip(i, 0, len(self.keys) - 1)
        return np.where(self.keys[i] == keys, i, -1)


class Recent:
    """A hash's answers by key, one remembered per place; frequent pairs skip its three mixes and divisions."""

    BITS = 18

    def __init__(self, table: Hash):
        self.table = table
        self.keys, self.at = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            place = ((keys.astype(np.uint64) * M1) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.at[place]
        new = np.flatnonzero(self.keys[place] != keys)
        if len(new):
            out[new] = self.table.index(keys[new])
            self.keys[place[new]], self.at[place[new]] = keys[new], out[new]
        return out


# ------------------------------------------------------------------------------------------------- job

def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def link_pairs(docs: DataFrame, files) -> DataFrame:
    """Pass 1: (key, n) per task and distinct pair, written to the shared folder."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(files)  # the two tokenizer files, about 2 MB

    def run(batches):
        al = Aligner.of(sent.value)
        for pdf in batches:
            keys = [part.keys() for part in al.align_all(pdf["text"].tolist())]
            if keys:
                k, n = pa.array(np.concatenate(keys)).value_counts().flatten()
                yield pd.DataFrame({"key": k.to_numpy(), "n": n.to_numpy()})

    return shared.written(shared.long_texts(docs).mapInPandas(run, "key long, n long"), "pairs")


def perfect_hash(pairs: DataFrame, cfg: Config) -> Hash:
    """Pass 2: the minimal perfect hash of all distinct keys, built part by part in tasks."""
    distinct = pairs.select("key").distinct()
    total = distinct.count()
    if total > cfg.max_pairs:
        raise OverflowError(total)
    n_parts = max(1, math.ceil(total / cfg.part_keys))

    def tag(batches):
        for pdf in batches:
            yield pd.DataFrame({"p": part_of(pdf["key"].to_numpy(), n_parts), "key": pdf["key"]})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seeds, rank, keys = build_part(pdf["key"].to_numpy(), cfg.load)
        return pd.DataFrame({"p": [int(pdf["p"].iloc[0])], "seeds": [seeds], "rank": [rank], "keys": [keys]})

    parts = (distinct.mapInPandas(tag, "p long, key long").groupBy("p")
             .applyInPandas(build, "p long, seeds array<long>, rank array<long>, keys array<long>"))
    rows = parts.collect()  # n_parts rows of about 13 bytes a key: bounded by max_pairs above
    return Hash([(r["p"], np.array(r["seeds"], np.int64), np.array(r["rank"], np.int64), np.array(r["keys"], np.int64))
                 for r in rows], n_parts)


def dense_counts(pairs: DataFrame, h: Hash) -> tuple[np.ndarray, np.ndarray]:
    """Pass 3: per-task dense vectors indexed by the hash, summed in a tree; and the best flags."""
    sent = pairs.sparkSession.sparkContext.broadcast(h)
    size = len(h)

    def dense(rows):
        table = sent.value
        keys, ns = [], []
        for r in rows:
            keys.append(r["key"])
            ns.append(r["n"])
        idx = table.index(np.array(keys, np.int64))
        if (idx < 0).any():
            raise ValueError("a pair is missing from the perfect hash")
        yield np.bincount(idx, weights=np.array(ns, np.float64), minlength=size).astype(np.int64)

    depth = max(2, math.ceil(math.log2(max(2, pairs.rdd.getNumPartitions())) / 3))
    counts = pairs.rdd.mapPartitions(dense).treeReduce(np.add, depth=depth) if size else np.zeros(0, np.int64)
    best = np.zeros(B_IDS, np.int64)
    np.maximum.at(best, h.keys % B_IDS, counts)
    return counts, counts == best[h.keys % B_IDS]


def _results(parts: Iterator[Aligned], counts_of) -> dict:
    """The result columns but doc_id; ``counts_of`` gives a key's count and whether it is its B id's highest."""
    cols: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
    digests: list[str] = []
    for p in parts:
        count, best = counts_of(p.keys())
        links = p.links
        for name, values in (("n_a", p.na), ("n_b", p.nb), ("n_groups", links), ("n_links", links),
                             ("n_best", _sums(best, links)), ("count_sum", _sums(count, links))):
            cols[name].append(p.spread(values))
        digests += p.digests()
    none = [np.zeros(0, np.int64)]
    return {c: np.concatenate(v or none) for c, v in cols.items()} | {"groups_sha256": digests}


SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def realigned(docs: DataFrame, files, h: Hash, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """The second pass: every document aligned again, its links' counts looked up by the hash."""
    sent = docs.sparkSession.sparkContext.broadcast((files, h, counts, best))  # bounded by max_pairs

    def run(batches):
        files_, table, cnt, flag = sent.value
        al, recent = Aligner.of(files_), Recent(table)

        def counts_of(keys):
            i = recent.index(keys)
            return cnt[i], flag[i]

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **_results(al.align_all(pdf["text"].tolist()), counts_of)})

    return shared.long_texts(docs).mapInPandas(run, SCHEMA)


def realigned_by_join(docs: DataFrame, files, pairs: DataFrame) -> DataFrame:
    """The way beyond ``max_pairs``: counts by a shuffle aggregate, looked up by a join on the pair."""
    counts = pairs.groupBy("key").agg(F.sum("n").alias("c"))
    # one row per distinct pair; a B id's pairs are at most the A vocabulary
    counts = counts.withColumn("best", F.col("c") == F.max("c").over(Window.partitionBy(F.col("key") % B_IDS)))
    sent = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        al = Aligner.of(sent.value)
        for pdf in batches:
            parts = list(al.align_all(pdf["text"].tolist()))
            keys = [k for p in parts for k in np.split(p.keys(), np.cumsum(p.spread(p.links))[:-1])]
            none = lambda keys: (np.zeros(len(keys), np.int64),) * 2
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **_results(parts, none), "row": pdf["row"], "keys": keys})

    rows = shared.written(shared.long_texts(docs.withColumn("row", F.monotonically_increasing_id())).mapInPandas(
        run, SCHEMA + ", row long, keys array<long>"), "links")
    linked = (rows.select("row", F.explode("keys").alias("key")).join(counts, "key")
              .groupBy("row").agg(F.sum("c").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best")))
    return (rows.drop("keys", "count_sum", "n_best").join(linked, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"))


def alignment(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the alignment digest and its corpus-wide counts."""
    docs = _docs(docs)
    files = tokenizer_files(cfg)
    pairs = link_pairs(docs, files)
    try:
        h = perfect_hash(pairs, cfg)
    except OverflowError:
        return realigned_by_join(docs, files, pairs)
    counts, best = dense_counts(pairs, h)
    return realigned(docs, files, h, counts, best)


def of_documents(spark: SparkSession, path: str, cfg: Config = Config()) -> DataFrame:
    return alignment(spark.read.parquet(path), cfg)
