"""Line-first quality rules: judge each line, remove the failures, then judge what is left.

A line fails by one of three rules.
* punctuation: too many of its words carry symbols or doubled exclamation or question marks, or
  it is short and has no closing punctuation;
* navigation: separators stand between its words as in a menu;
* boilerplate: it holds a phrase of site notices.
A document is rejected if its failed lines hold too large a share of its words, or if it fails the
base rules (too few words, or too many words inside repeated 5-word windows).

Defined cases: null and empty texts have no words, fail the base rules and keep a null or empty
text; lines without a word never fail; whole texts are read; equal rows get equal verdicts; only
the named columns are read, others are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from expband.llm import blocks, shared

SYMBOLS = blocks.byte_table("#*$%&|<>")
SHOUTS = blocks.byte_table("!?")
SEPARATORS = blocks.byte_table("|>*-")
NEWLINE = blocks.byte_table("\n")
#: Bytes that close a sentence; a last character outside ASCII counts as closing too.
CLOSING = blocks.byte_table(".!?\"':;)]}")
CLOSING[128:] = True
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "click here", "enable javascript", "javascript is disabled", "sign up for our newsletter",
    "skip to content", "powered by wordpress", "lorem ipsum",
)
NOTICE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.IGNORECASE)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; shares are of words."""

    min_words: int = 10                  #: base: fewer fail
    max_repeat_percent: int = 20         #: base: more words than this in repeated 5-word windows fail
    max_marked: float = 0.3              #: line: words with symbols or doubled marks
    short_line: int = 4                  #: line: up to so many words need closing punctuation
    min_separators: int = 3              #: line: a menu has so many separators at least,
    separator_share: float = 0.2         #: and this share of its words
    max_lost: float = 0.5                #: document: words in failed lines


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines",
          "n_lost_words")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[end] - total[start]


def _earlier_equal(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where the same key has occurred before in the same row."""
    order = np.lexsort((np.arange(len(key)), key, row))
    k, r = key[order], row[order]
    out = np.zeros(len(key), dtype=bool)
    if len(key):
        out[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return out


def _repeated_words(words: blocks.Words, size: int = 5) -> np.ndarray:
    """Per row, the words inside windows that occur twice or more in the row."""
    n = len(words)
    starts, key = blocks.windows(words.hashes(), words.first, size)
    row = words.row[starts]
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(k), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts[order[twice]], 1)
    np.add.at(change, starts[order[twice]] + size, -1)
    return _per_row(np.cumsum(change[:-1]) > 0, words.first)


def examine(texts: pa.Array, limits: Limits) -> tuple[dict[str, np.ndarray], blocks.Words, np.ndarray]:
    """The counts of each text, the non-empty lines, and which of these fail."""
    words = blocks.Words(texts)
    raw, offsets = words.raw, words.offsets
    inside = words._inside
    lines = blocks.Words(texts, breaks=NEWLINE)
    word_at = np.zeros(len(raw) + 1, np.int64)
    word_at[words.start] = 1
    word_at = np.concatenate(([0], np.cumsum(word_at[:-1])))
    n_words = word_at[lines.end] - word_at[lines.start]      # words begin and end within a line
    worded = n_words > 0

    doubled = np.zeros(len(raw), dtype=bool)
    doubled[:-1] = SHOUTS[raw[:-1]] & SHOUTS[raw[1:]]
    marked = _within(SYMBOLS[raw] | doubled, words.start, words.end) > 0
    alone = (words.end - words.start == 1)
    separator = alone & SEPARATORS[raw[words.start]] if len(words) else alone
    first = word_at[lines.start]
    n_marked = _within(marked, first, first + n_words)
    n_separators = _within(separator, first, first + n_words)
    closed = np.zeros(len(lines), dtype=bool)
    closed[worded] = CLOSING[raw[words.end[(first + n_words - 1)[worded]] - 1]]
    failed = worded & ((n_marked > limits.max_marked * n_words)
                       | ((n_words <= limits.short_line) & ~closed)
                       | ((n_separators >= limits.min_separators)
                          & (n_separators >= limits.separator_share * n_words)))
    pattern = "(?i)" + "|".join(map(re.escape, BOILERPLATE))
    for k in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, pattern), False)
                            .to_numpy(zero_copy_only=False)):
        for i in range(lines.first[k], lines.first[k + 1]):
            if NOTICE.search(raw[lines.start[i]:lines.end[i]].tobytes()):
                failed[i] = worded[i]

    counts = {
        "n_words": words.counts,
        "word_chars": _per_row(inside & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(SYMBOLS[raw], offsets),
        "n_dup_lines": _per_row(_earlier_equal(lines.hashes(), lines.row) & worded, lines.first),
        "n_repeat_words": _repeated_words(words),
        "n_failed_lines": _per_row(failed, lines.first),
        "n_lost_words": _per_row(np.where(failed, n_words, 0), lines.first),
    }
    return counts, lines, failed


def _cleaned(texts: pa.Array, lines: blocks.Words, failed: np.ndarray) -> list[str | None]:
    """The texts without their failed lines; blank lines stay."""
    out = texts.to_pylist()
    hit = np.unique(lines.row[failed])
    for k in hit:
        base = lines.offsets[k]
        raw, at, kept = lines.raw[base:lines.offsets[k + 1]].tobytes(), 0, []
        for i in range(lines.first[k], lines.first[k + 1]):
            if failed[i]:
                start, end = int(lines.start[i] - base), int(lines.end[i] - base)
                kept.append(raw[at:start])
                at = min(end + 1, len(raw))  # with its line feed
        text = (b"".join(kept) + raw[at:]).decode("utf-8")
        out[k] = text[:-1] if failed[lines.first[k + 1] - 1] and text.endswith("\n") else text
    return out


def clean_lines(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """All rows with a ``quality`` struct: the counts, ``base_failed``, ``kept``, ``cleaned`` text."""
    rest = [c for c in df.columns if c != "quality"]
    quality = T.StructType([T.StructField(c, T.LongType()) for c in FIELDS]
                           + [T.StructField("base_failed", T.BooleanType()),
                              T.StructField("kept", T.BooleanType()),
                              T.StructField("cleaned", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in blocks.slices(batch, text):
                    texts = part.column(text)
                    counts, lines, failed = examine(texts, limits)
                    n = counts["n_words"]
                    base = ((n < limits.min_words)
                            | (100 * counts["n_repeat_words"] > limits.max_repeat_percent * n))
                    kept = ~base & (counts["n_lost_words"] <= limits.max_lost * n)
                    struct = pa.StructArray.from_arrays(
                        [*(pa.array(counts[c].astype(np.int64)) for c in FIELDS), pa.array(base),
                         pa.array(kept), pa.array(_cleaned(texts, lines, failed), pa.string())],
                        names=[*FIELDS, "base_failed", "kept", "cleaned"])
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), struct],
                                                     names=[*rest, "quality"])

    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("quality", quality)])
    return shared.long_texts(df).select(*rest).mapInArrow(run, schema)


def of_documents(spark: SparkSession, path: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = clean_lines(spark.read.parquet(path).select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in
                                  (*FIELDS, "base_failed", "kept")])
