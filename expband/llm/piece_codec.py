"""SentencePiece BPE encoding by backtracking, and decoding.

A chunk of text is covered from the left with the longest piece an Aho-Corasick automaton finds
at each place. A piece may follow another only if merging both anew would keep the border between
them; that is checked by undoing their merges one at a time. Where no piece fits, the last one is
taken back and the place is marked in a bitfield of failed positions, so no place is tried twice.
The result is the one sequence of pieces whose neighbours are all compatible, which is what
merging pair by pair yields.

Defined cases: null and empty texts have no ids and decode to the empty text; characters outside
the vocabulary become byte pieces; texts are never cut; equal rows give equal results; a column
that has the name of the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from expband.llm.shared import long_texts

SPACE = "▁"
#: Letters that no piece continues with another kind of character; checked when a model is read.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Borders between these chunks are crossed by no piece, so chunks are encoded one by one.
CHUNKS = re.compile(f"{SPACE}*[^{LETTERS}{SPACE}\n]*[{LETTERS}]+|{SPACE}*[^{LETTERS}{SPACE}\n]+|{SPACE}+|\n")
#: Chunks remembered by a Python worker in each of two generations, and the longest of them.
CACHE_CHUNKS, CACHE_LENGTH = 150_000, 40


@dataclass(frozen=True, eq=False)
class PieceTable:
    """What encoding and decoding need of a model; sized by its vocabulary."""

    pieces: tuple[str, ...]            #: by id
    byte_ids: tuple[int, ...]          #: id of each byte's piece
    order: tuple[int, ...]             #: ids by rank: single characters, then merges in their order
    halves: tuple[tuple[int, int], ...]  #: by rank, the two ranks last merged; itself for a character
    runs: tuple[tuple[int, ...], ...]  #: by number of spaces up to the longest piece: their pieces' lengths


def read_table(model_file: str) -> PieceTable:
    """Read a BPE model with byte fallback; raises ValueError on models of other kinds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    byte_ids = [i for i in ids if model.is_byte(i)]
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i)
                                    or model.is_unknown(i) or model.is_unused(i))]
    if len(byte_ids) != 256:
        raise ValueError("only models with byte fallback are supported")
    if model.encode("a") and not model.id_to_piece(model.encode("a")[0]).startswith(SPACE):
        raise ValueError("only models that put a space before the text are supported")
    runs = {i for i in plain if len(pieces[i]) > 1 and not pieces[i].strip(SPACE)}
    merges = [i for i in plain if len(pieces[i]) > 1 and i not in runs]
    if len({model.get_score(i) for i in merges}) != len(merges):
        raise ValueError("merges with equal scores have no defined order")
    lowest = min([0.0, *(model.get_score(i) for i in merges)])
    if len({model.get_score(i) for i in runs}) > 1 or any(model.get_score(i) >= lowest for i in runs):
        raise ValueError("pieces of spaces must merge last and have one score")
    sizes = {1, *(len(pieces[i]) for i in runs)}
    longest = max(sizes)
    merged = [_merge_spaces(n, sizes) for n in range(3 * longest)]
    if any(merged[n] != [longest, *merged[n - longest]] for n in range(longest, 3 * longest)):
        raise ValueError("a run of spaces must begin with the longest piece of spaces")
    crossing = re.compile(f"[^{SPACE}]{SPACE}|[{LETTERS}][^{LETTERS}{SPACE}]|\n")
    if any(crossing.search(pieces[i]) for i in plain):
        raise ValueError("a piece crosses a chunk border")
    order = ([i for i in plain if len(pieces[i]) == 1]
             + sorted(merges, key=model.get_score, reverse=True))
    rank = {pieces[i]: r for r, i in enumerate(order)}
    return PieceTable(tuple(pieces), tuple(byte_ids), tuple(order),
                      tuple(_last_merge(pieces[i], rank) for i in order),
                      tuple(map(tuple, merged[:longest + 1])))


def _merge_spaces(n: int, sizes: set[int]) -> list[int]:
    """Lengths of the pieces of n spaces: equal scores merge the leftmost pair first."""
    parts = [1] * n
    while True:
        k = next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in sizes), None)
        if k is None:
            return parts
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def _last_merge(piece: str, rank: dict[str, int]) -> tuple[int, int]:
    """The ranks merged last when the piece itself is encoded; (-1, -1) if that never yields it."""
    parts = list(piece)
    if len(parts) == 1:
        return rank[piece], rank[piece]
    while len(parts) > 1:
        found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not found:
            return -1, -1
        _, k = min(found)
        if len(parts) == 2:
            return rank[parts[0]], rank[parts[1]]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return -1, -1


class Encoder(dict):
    """Maps chunks to their ids as little-endian 32-bit bytes; remembers short ones."""

    def __init__(self, table: PieceTable):
        import ahocorasick

        super().__init__()
        self.order, self.halves, self.byte_ids = table.order, table.halves, table.byte_ids
        self.run_ids = {len(p): i for i, p in enumerate(table.pieces) if p and not p.strip(SPACE)}
        self.runs = table.runs
        self.joined = {pair: r for r, pair in enumerate(table.halves) if pair[0] >= 0 and pair != (r, r)}
        self.characters = {table.pieces[i]: r for r, i in enumerate(table.order) if len(table.pieces[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for r, i in enumerate(table.order):
            if table.halves[r][0] >= 0 and len(table.pieces[i]) > 1:
                self.automaton.add_word(table.pieces[i], (r, len(table.pieces[i])))
        self.automaton.make_automaton()
        self.checked: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = np.array(self.encode_chunk(chunk), dtype="<i4").tobytes()
        if len(chunk) <= CACHE_LENGTH:
            if len(self) >= CACHE_CHUNKS:  # two generations: the full one becomes the older one
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def encode_text(self, text: str) -> bytes:
        """Ids of a whole text."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, CHUNKS.findall(SPACE + text.replace(" ", SPACE))))

    def encode_chunk(self, chunk: str) -> list[int]:
        """A chunk is spaces, then other characters; pieces of spaces merge last, from the left."""
        body = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(body)
        ids = self.encode_word(SPACE * min(1, spaces) + body)
        if spaces > 1 or (spaces and not body):
            own = ids[:1] != [self.run_ids[1]]  # the last space went into a longer piece
            ids = ids if own else ids[1:]
            longest = len(self.runs) - 1
            full, rest = divmod(spaces - own, longest)
            ids = ([self.run_ids[longest]] * full + [self.run_ids[n] for n in self.runs[rest]] + ids)
        return ids

    def encode_word(self, text: str) -> list[int]:
        """Backtracking over the pieces found at each place."""
        found = [[(self.characters.get(c), 1)] for c in text]
        for last, piece in self.automaton.iter(text):
            found[last + 1 - piece[1]].append(piece)
        ids: list[int] = []
        at = 0
        for k, here in enumerate(found):
            if here[0][0] is None:  # a character outside the vocabulary: nothing merges across it
                ids += self._cover(found, at, k)
                ids += [self.byte_ids[b] for b in text[k].encode("utf-8")]
                at = k + 1
        return ids + self._cover(found, at, len(text))

    def _cover(self, found: list[list[tuple[int, int]]], start: int, stop: int) -> list[int]:
        """Ids from start to stop, where every place has a piece."""
        failed = bytearray((stop - start) // 8 + 1)
        taken: list[tuple[int, int, int]] = []  # rank, length, index among the pieces found there
        checked, at, choice = self.checked, start, -1
        while at < stop:
            here = found[at]
            if choice < 0:
                choice = len(here) - 1
            while choice >= 0:
                rank, size = here[choice]
                off = at + size - start
                if not failed[off >> 3] >> (off & 7) & 1:
                    if not taken:
                        break
                    pair = taken[-1][0] << 32 | rank
                    good = checked.get(pair)
                    if good is None:
                        if len(checked) >= CACHE_CHUNKS:
                            checked.clear()
                        good = checked[pair] = self.compatible(taken[-1][0], rank)
                    if good:
                        break
                choice -= 1
            if choice >= 0:
                taken.append((rank, size, choice))
                at += size
                choice = -1
            else:  # take the last piece back; its end is now marked, so a shorter one follows
                off = at - start
                failed[off >> 3] |= 1 << (off & 7)
                _, size, choice = taken.pop()
                at -= size
        return [self.order[rank] for rank, _, _ in taken]

    def compatible(self, left: int, right: int) -> bool:
        """True if merging the characters of both anew leaves the border between them.

        The later of the two pieces is undone first. At each step the parts that touch at the
        border must not have a merge that comes before the merges undone so far.
        """
        halves, joined = self.halves, self.joined
        bound = len(halves)
        while True:
            whole = joined.get((left, right))
            if whole is not None and whole < bound:
                return False
            if left > right and halves[left][1] != left:
                bound, left = left, halves[left][1]
            elif halves[right][0] != right:
                bound, right = right + 1, halves[right][0]
            elif halves[left][1] != left:
                bound, left = left, halves[left][1]
            else:
                return True


_LATEST: list[tuple[PieceTable, Encoder]] = []


def _encoder(table: PieceTable) -> Encoder:
    """The encoder of this worker, which keeps its memory from task to task."""
    if not _LATEST or (_LATEST[0][0] is not table and _LATEST[0][0].pieces != table.pieces):
        _LATEST[:] = [(table, Encoder(table))]
    return _LATEST[0][1]


def _encoded(texts: pa.Array, encoder: Encoder) -> pa.ListArray:
    rows = [encoder.encode_text(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
    ids = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends), ids)


def _decoded(ids: pa.Array, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    data, at, size = pieces
    counts = np.array([len(x) if x.is_valid else 0 for x in ids])
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    length = size[flat]
    place = np.concatenate(([0], np.cumsum(length)))
    raw = data[np.repeat(at[flat] - place[:-1], length) + np.arange(place[-1])].tobytes()
    ends = place[np.concatenate(([0], np.cumsum(counts)))]
    return pa.array([_text(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.string())


IDS, TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def _with_columns(df: DataFrame, source: str, table: PieceTable, fresh: dict[str, T.DataType],
                  make: Callable[[pa.Array, PieceTable], list[pa.Array]]) -> DataFrame:
    """Add columns made from one column, in one pass over slices of the rows."""
    sent = long_texts(df).sparkSession.sparkContext.broadcast(table)  # sized by the vocabulary
    rest = [c for c in df.columns if c not in fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), *make(part.column(source), sent.value)],
                    names=[*rest, *fresh])

    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, t) for c, t in fresh.items()])
    return df.select(*dict.fromkeys([*rest, source])).mapInArrow(run, schema)


def encode(df: DataFrame, text: str, table: PieceTable, into: str = "piece_ids") -> DataFrame:
    """Add the ids of every whole text as an array of ints."""
    return _with_columns(df, text, table, {into: IDS}, lambda texts, t: [_encoded(texts, _encoder(t))])


def decode(df: DataFrame, ids: str, table: PieceTable, into: str = "decoded") -> DataFrame:
    """Add the text of an array of ids; bytes that are no UTF-8 become U+FFFD, one each.

    Ids outside the vocabulary raise an error; control pieces decode to nothing.
    """
    return _with_columns(df, ids, table, {into: TEXT}, lambda column, t: [_decoded(column, _piece_bytes(t))])


@lru_cache(maxsize=1)
def _piece_bytes(table: PieceTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' bytes joined, and where each begins and how long it is."""
    of_byte = {i: bytes([b]) for b, i in enumerate(table.byte_ids)}
    plain = set(table.order)
    parts = [of_byte.get(i, p.replace(SPACE, " ").encode("utf-8")
                         if i in plain or (p and not p.strip(SPACE)) else b" \xe2\x81\x87 " if i == 0 else b"")
             for i, p in enumerate(table.pieces)]
    size = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])), size


def _text(raw: bytes) -> str:
    raw = raw[1:] if raw[:1] == b" " else raw
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[k:k + size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append("�")
            k += size
        return "".join(out)


def encode_and_decode(df: DataFrame, text: str, model_file: str) -> DataFrame:
    """Add ``piece_ids`` and ``decoded``, the text of these ids, in one pass; the text stays behind."""
    def both(texts: pa.Array, table: PieceTable) -> list[pa.Array]:
        ids = _encoded(texts, _encoder(table))
        return [ids, _decoded(ids, _piece_bytes(table))]
    return _with_columns(df, text, read_table(model_file), {"piece_ids": IDS, "decoded": TEXT}, both).drop(text)


def digests(df: DataFrame) -> DataFrame:
    """Number of ids and the SHA-256 of ids and decoded text, in place of both."""
    ids = F.col("piece_ids")
    return df.select(
        *[c for c in df.columns if c not in ("piece_ids", "decoded")],
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def default_model() -> str:
    """The public 32k model's file on this machine; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def of_documents(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.parquet(path).select("doc_id", "text")
    return digests(encode_and_decode(docs, "text", default_model()))
