"""Licence notices in texts by a positional index of rare licence words.

The words of all templates form a small vocabulary. Its document frequencies are counted over all
texts. In each template the words with the highest IDF are its postings: word, template, place. A
text's occurrences of such words are looked up in the postings; two of them that agree on where the
template would begin (place in the text less place in the template) make a candidate. It is verified
by the template's mandatory key phrases inside that stretch, and scored by the IDF share of the
template's words that stand at their place.

Besides, base phrases are found wherever their words stand next to each other.

Defined cases: null and empty texts have no words, no labels and score 0; a notice cut off by either
end of a text is compared with what is there; overlapping and repeated notices count once as a
label and at each place as a base phrase; repeated rows get equal results; rows with a null doc_id
are scanned like any other. Whole texts are read; extra columns are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.llm import blocks

#: Bytes between words: all ASCII but digits and lower-case letters (texts are lower-cased first).
BREAKS = np.zeros(256, dtype=bool)
BREAKS[:128] = True
BREAKS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licences, each with the phrases it can't be without.
TEMPLATES = {
    "mit-notice": ("released under the mit license", ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software "
                 "and associated documentation files the software to deal in the software without restriction "
                 "including without limitation the rights to use copy modify merge publish distribute sublicense "
                 "and or sell copies of the software",
                 ("permission is hereby granted", "without restriction")),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3",
                ("gnu general public license", "version 3")),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of "
                   "the gnu general public license as published by the free software foundation",
                   ("gnu general public license", "free software foundation")),
    "lgpl-notice": ("redistribute it and or modify it under the terms of the gnu lesser general public license "
                    "as published by the free software foundation", ("gnu lesser general public license",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                ("mozilla public license",)),
    "bsd-text": ("redistribution and use in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met",
                 ("redistribution and use in source and binary forms", "following conditions are met")),
    "isc-text": ("permission to use copy modify and or distribute this software for any purpose with or without "
                 "fee is hereby granted", ("with or without fee",)),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  ("unencumbered software", "public domain")),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "all-rights-reserved": ("all rights reserved", ("all rights reserved",)),
}


@dataclass(frozen=True)
class Scan:
    rare_words: int = 4        #: a template's words with the highest IDF that are its postings
    agreeing: int = 2          #: postings that must agree on the template's place
    min_score: float = 0.6     #: least IDF share of a template's words at their places


VOCABULARY = sorted({w for text, _ in TEMPLATES.values() for w in text.split()}
                    | {w for phrase in BASE_PHRASES for w in phrase.split()})
_ID = {w: k + 1 for k, w in enumerate(VOCABULARY)}   # 0: any other word


def _ids(text: str) -> np.ndarray:
    return np.array([_ID[w] for w in text.split()])


def _word_ids(words: blocks.Words) -> np.ndarray:
    """The vocabulary's id of each word, 0 for others."""
    known = blocks.Words(pa.array(VOCABULARY), breaks=BREAKS).hashes()
    order = np.argsort(known)
    hashes = words.hashes()
    at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
    return np.where(known[order][at] == hashes, order[at] + 1, 0)


def _phrase_starts(ids: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase's words stand next to each other in one row."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(ids[:n] == phrase[0])
    for k, word in enumerate(phrase[1:], 1):
        at = at[ids[at + k] == word]
    return at[row[at] == row[at + len(phrase) - 1]]


def _texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, blocks.Words, np.ndarray]]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in blocks.slices(batch, text):
                words = blocks.Words(part.column(text), lower=True, breaks=BREAKS)
                yield part, words, _word_ids(words)


def word_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Number of texts, then the texts that hold each vocabulary word; counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(VOCABULARY) + 1, np.int64)
        for part, words, ids in _texts(batches, text):
            seen = np.unique(words.row[ids > 0] * np.int64(len(total)) + ids[ids > 0])
            total += np.bincount(seen % len(total), minlength=len(total))
            total[0] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    counts = docs.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(VOCABULARY) + 1, np.int64)
    for word, n in counts.collect():   # one row per word of the vocabulary
        out[word] = n
    return out


def scan(docs: DataFrame, options: Scan = Scan(), text: str = "text") -> DataFrame:
    """doc_id with n_words, base places and labels, all labels and the best score."""
    frequency = word_frequencies(docs, text)
    idf = np.log((frequency[0] + 1) / (frequency + 1.0)) + 1e-9
    idf[0] = 0.0
    templates = []
    for label, (body, phrases) in TEMPLATES.items():
        ids = _ids(body)
        rare = np.argsort(-idf[ids], kind="stable")[:options.rare_words]
        templates.append((label, ids, rare, [_ids(p) for p in phrases]))
    bases = [(_ids(p), label) for p, label in BASE_PHRASES.items()]

    def found(words: blocks.Words, ids: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """Row, label and score of every verified candidate."""
        marked = np.flatnonzero(ids)
        for label, body, rare, phrases in templates:
            begin, source = [], []
            for k in rare:
                here = marked[ids[marked] == body[k]]
                begin.append(here - k)
                source.append(words.row[here])
            begin, source = np.concatenate(begin), np.concatenate(source)
            pairs, votes = np.unique(np.stack((source, begin)), axis=1, return_counts=True)
            for row, at in pairs[:, votes >= min(options.agreeing, len(rare))].T:
                low, high = max(at, words.first[row]), min(at + len(body), words.first[row + 1])
                there, wanted = ids[low:high], body[low - at:high - at]
                score = float(idf[wanted[there == wanted]].sum() / idf[body].sum())
                inside = np.zeros(len(there), np.int64)
                if score >= options.min_score and all(len(_phrase_starts(there, inside, p)) for p in phrases):
                    yield int(row), label, min(score, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, ids in _texts(batches, text):
            n = part.num_rows
            labels: list[set[str]] = [set() for _ in range(n)]
            starts = []
            for phrase, label in bases:
                at = _phrase_starts(ids, words.row, phrase)
                starts.append(at)
                for row in np.unique(words.row[at]):
                    labels[row].add(label)
            starts = np.sort(np.concatenate(starts))
            count = np.bincount(words.row[starts], minlength=n)
            place = starts - words.first[words.row[starts]]
            ends = np.cumsum(count)
            first = [int(place[e - c]) if c else None for e, c in zip(ends, count)]
            last = [int(place[e - 1]) if c else None for e, c in zip(ends, count)]
            base = [",".join(sorted(x)) for x in labels]
            score = np.zeros(n)
            for row, label, value in found(words, ids):
                labels[row].add(label)
                score[row] = max(score[row], value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(count.astype(np.int64)),
                 pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base),
                 pa.array([",".join(sorted(x)) for x in labels]), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
             "base_labels string, labels string, score double")


def of_documents(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark.read.parquet(path))
