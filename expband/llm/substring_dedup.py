"""Repeated word windows, found level by level with doubled lengths.

A window is ``window`` consecutive words of one text. At each level, of 9, 18 and at last 35 words
by default, a window is stood for by its anchor: that of the word sequences of the level's length
inside it whose hash is least. Equal windows have equal anchors, so a window whose anchor occurs
nowhere else is not repeated. Only windows with a repeated anchor are extended to the next length;
at the last level the anchor is the window itself. Neighbouring windows share anchors, so a first
level needs one row for about 14 words.

Equal texts are one text with a number of copies. Each task joins the occurrences of a key in its
slice to one row, so a very common passage costs a row per slice, not one per document.

A key has 64 bits at the lower levels, where a collision costs work only, and 95 bits at the last.

Defined cases: null and empty texts have no words and keep nothing; texts shorter than a window
keep all; repeated rows and equal texts are each other's elsewhere; doc_id may be null or repeat;
texts of any length are read whole. Extra columns are carried along by ``remove_repeats``; its own
columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from expband.llm import blocks, shared

WINDOW = 35
SHORTEST = 8
SLICE_BYTES = 1 << 21
OTHER = np.uint64(0xA0761D6478BD642F)
#: The identity of a text: 96 bits of two hashes.
KEYS = ("text_key", "text_mark")


def level_lengths(window: int) -> list[int]:
    """Lengths from the shortest on, each at most twice the one before, up to the window."""
    lengths = [window]
    while (half := -(-lengths[0] // 2)) >= SHORTEST:
        lengths.insert(0, half)
    return lengths


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({KEYS[0]: F.xxhash64(content), KEYS[1]: F.hash(content)})


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_key, text_mark, text, copies: equal texts once, combined before the shuffle."""
    return keyed(shared.long_texts(docs), text).groupBy(*KEYS).agg(
        F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.count("*").alias("copies"))


def _anchors(words: blocks.Words, hashes: np.ndarray, starts: np.ndarray, length: int,
             window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the place of its anchor; the hash at every place."""
    at, key = blocks.windows(hashes, words.first, length)
    value = np.full(len(hashes), np.iinfo(np.uint64).max)
    value[at] = key
    best, span, step = np.arange(len(value)), window - length + 1, 1

    def lesser(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(value[right] < value[left], right, left)

    while step * 2 <= span:
        right = np.minimum(np.arange(len(value)) + step, len(value) - 1)
        best, step = lesser(best, best[right]), step * 2
    if not len(starts):
        return starts, value
    return lesser(best[starts], best[starts + span - step]), value


def _places(part: pa.RecordBatch, words: blocks.Words) -> np.ndarray:
    """Mask over the slice's words: the places in the ``places`` lists of its rows."""
    lists = part.column("places")
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != counts.sum():  # null lists
        counts = np.array([len(x) if x.is_valid else 0 for x in lists])
    mask = np.zeros(len(words) + 1, dtype=bool)
    mask[np.repeat(words.first[:-1], counts) + flat] = True
    return mask


def level_rows(texts: DataFrame, length: int, before: int | None, window: int) -> DataFrame:
    """key, mark, n, members: the anchors of one level, those of a slice with one key joined.

    ``before`` is the length of the level below, whose repeated anchors are in ``places``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text", SLICE_BYTES):
                    yield rows(part)

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        words = blocks.Words(part.column("text"))
        hashes = words.hashes()
        starts, _ = blocks.windows(hashes, words.first, window)
        if before is not None:
            anchor, _ = _anchors(words, hashes, starts, before, window)
            starts = starts[_places(part, words)[anchor]]
        anchor, value = _anchors(words, hashes, starts, length, window)
        anchor = np.unique(anchor)
        key, mark = value[anchor], np.zeros(len(anchor), np.uint64)
        if length == window:
            at, other = blocks.windows(blocks.mix(hashes ^ OTHER), words.first, window)
            mark = (other >> np.uint64(33))[np.searchsorted(at, anchor)]
        order = np.lexsort((anchor, mark, key))
        anchor, key, mark = anchor[order], key[order], mark[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        first = np.flatnonzero(fresh)
        row = words.row[anchor]
        members = pa.StructArray.from_arrays(
            [part.column(KEYS[0]).take(pa.array(row)), part.column(KEYS[1]).take(pa.array(row)),
             pa.array((anchor - words.first[row]).astype(np.int32))], names=[*KEYS, "place"])
        offsets = np.append(first, len(key)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks.signed(key[first])), pa.array(mark[first].astype(np.int32)),
             pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), members)],
            names=["key", "mark", "n", "members"])

    # The same columns at all levels, so that all read one exchange of the texts.
    columns = [*KEYS, "text", "copies"] + ([] if before is None else ["places"])
    return texts.select(*columns).mapInArrow(
        run, f"key bigint, mark int, n bigint, members array<struct<{KEYS[0]}: bigint, {KEYS[1]}: int, place: int>>")


def repeated_places(rows: DataFrame) -> DataFrame:
    """text_key, text_mark, places: where each text has a key that occurs twice or more."""
    total = F.sum("n").over(Window.partitionBy("key", "mark"))
    return (rows.withColumn("total", total).filter("total > 1").select(F.explode("members").alias("m"))
            .select("m.*").groupBy(*KEYS).agg(F.collect_list("place").alias("places")))


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """text_key, text_mark, places: starts of all windows that occur elsewhere too."""
    before, found = None, texts
    for length in level_lengths(window):
        found = repeated_places(level_rows(found, length, before, window))
        if length < window:
            found = texts.join(found, list(KEYS))
        before = length
    return found


def kept_texts(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """text_key, text_mark, n_words, n_removed, kept: one row for each distinct text.

    A text with copies is repeated as a whole, if it has a window at all.
    """
    texts = distinct_texts(docs, text)
    found = texts.join(repeated_windows(texts, window), list(KEYS), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, "text", SLICE_BYTES):
                    yield rows(part)

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        words = blocks.Words(part.column("text"))
        n = len(words)
        change = np.zeros(n + window, np.int64)
        starts = np.flatnonzero(_places(part, words)[:n])
        change[starts] += 1
        change[starts + window] -= 1
        gone = np.cumsum(change)[:n] > 0
        whole = (part.column("copies").to_numpy() > 1) & (words.counts >= window)
        gone |= np.repeat(whole, words.counts)
        stay = np.flatnonzero(~gone)
        length = words.end[stay] - words.start[stay] + 1      # and a space
        ends = np.concatenate(([0], np.cumsum(length)))
        source = np.repeat(words.start[stay] - ends[:-1], length) + np.arange(ends[-1])
        out = words.raw[np.minimum(source, max(len(words.raw) - 1, 0))]
        out[ends[1:] - 1] = 32
        per_row = np.bincount(words.row[stay], minlength=part.num_rows)
        at = ends[np.concatenate(([0], np.cumsum(per_row)))]
        kept = [out[a:max(a, b - 1)].tobytes() for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays(
            [part.column(KEYS[0]), part.column(KEYS[1]), pa.array(words.counts.astype(np.int64)),
             pa.array((words.counts - per_row).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*KEYS, "n_words", "n_removed", "kept"])

    return found.select(*KEYS, "text", "copies", "places").mapInArrow(
        run, f"{KEYS[0]} bigint, {KEYS[1]} int, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All rows and columns of docs with n_words, n_removed and kept (words joined by one space)."""
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", *KEYS)]
    return keyed(docs.select(*rest), text).join(kept_texts(docs, window, text), list(KEYS), "left").drop(*KEYS)


def of_documents(spark: SparkSession, path: str) -> DataFrame:
    """Digest of what is kept of each document; the digest is taken before rows are joined."""
    docs = spark.read.parquet(path).select("doc_id", "text")
    digests = kept_texts(docs).select(*KEYS, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return keyed(docs).drop("text").join(digests, list(KEYS), "left").drop(*KEYS)
