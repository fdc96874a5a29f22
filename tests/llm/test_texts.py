"""Pieces, line rules, substring dedup, near duplicates, licences: against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from expband.llm import (blocks, license_index, line_rules, minhash_tensor, piece_codec, substring_dedup)

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "a", "a b", "one two", "\x00", "  two  spaces ", "x" * 5000, "\U0001F600 é 中文",
       "word " * 3000, "Tail without end", "\tTabs\x0bhere\x0c"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a long text, repeated rows, and extra columns with the operators' names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "\n\n"), (6, "one two"), (None, "one two"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 AS n_words", "'x' AS kept", "'y' AS quality", "2 AS piece_ids", "3 AS decoded")


@pytest.fixture(scope="module")
def table():
    return piece_codec.read_table(piece_codec.default_model())


def test_words_and_hashes_agree_with_python():
    import pyarrow as pa

    texts = ["", "a b", None, "  x\ty\nz ", "é ü a", "a" * 300 + " b"]
    words = blocks.Words(pa.array(texts))
    found = [words.raw[a:b].tobytes().decode() for a, b in zip(words.start, words.end)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == len(set(found))
    assert hashes[found.index("a")] == hashes[len(found) - 3]


def test_pieces_equal_the_library_on_random_strings(table):
    import numpy as np
    import sentencepiece

    library, encoder = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model()), piece_codec.Encoder(table)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", " " * 15, " " * 33, "\n", "é", "▁", "</s>", "中", "\U0001F600", "\x00", ".com", "'s",
             "_{", "²", "20", "ing", "tion", "\t", "ﬁ", "->", "zzzz", "www."] + list(table.pieces[300:3000:7])
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode_text(text), "<i4").tolist() == library.encode(text), text


def test_pieces_of_odd_rows_come_back(odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    rows = piece_codec.encode_and_decode(odd, "text", piece_codec.default_model()).collect()
    assert len(rows) == odd.count()
    for r, (_, text, *_) in zip(rows, odd.collect()):
        assert list(r.piece_ids) == library.encode(text or "")
        assert r.decoded == library.decode(list(r.piece_ids)) == (text or "").replace("▁", " ")


def test_broken_bytes_decode_to_replacements(spark, table):
    ids = [[table.byte_ids[b] for b in b" \xff\xe2\x82 \xe2\x82\xac"], [1, 2], None]
    df = spark.createDataFrame([(i,) for i in ids], "ids array<int>")
    assert [r.decoded for r in piece_codec.decode(df, "ids", table).collect()] == ["��� €", "", ""]


def _base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered), failed)


def test_line_rules_base_counts(docs, odd):
    for df in (docs.select("doc_id", "text"), odd):
        texts = [r.text for r in df.collect()]
        got = [r.quality for r in line_rules.clean_lines(df).collect()]
        assert [(q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) for q in got] \
            == [_base(t) for t in texts]


def test_line_rules_remove_lines_then_judge(spark):
    good = "This is a line with enough words to be kept in the end."
    texts = [good, f"{good}\nHome | News | About | Contact\n{good[::-1]} ok.", "Buy### now*** cheap$$$ pills&&& " * 4,
             f"{good}\n\nAll rights reserved.\n", f"Menu\n{good}", "one | two | three | four | five | six | seven"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.quality for r in line_rules.clean_lines(df).collect()}
    assert [got[i].kept for i in range(6)] == [True, True, False, True, True, False]
    assert got[1].cleaned == f"{good}\n{good[::-1]} ok."
    assert got[3].cleaned == f"{good}\n" or got[3].cleaned == f"{good}\n\n"
    assert got[4].cleaned == good
    assert got[0].cleaned == good


def test_line_rules_keep_labelled_quality(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    verdict = line_rules.of_documents(spark, f"{sf}/documents.parquet").join(labels, "doc_id").filter("NOT base_failed")
    assert verdict.filter("quality = 1 AND NOT kept").count() == 0
    assert verdict.filter("quality = 0 AND kept").count() <= 0.02 * verdict.filter("quality = 0").count() + 1


def _kept(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [35, 20, 8])
def test_substring_dedup_brute_force(docs, odd, window):
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = substring_dedup.remove_repeats(df, window).collect()
        want = defaultdict(set)
        data = df.collect()
        for r, w in zip(data, _kept([r.text for r in data], window)):
            want[r.doc_id, r.text].add(w)
        assert len(rows) == len(data)
        for r in rows:
            assert {(r.n_words, r.n_removed, r.kept)} == want[r.doc_id, r.text]


def test_substring_dedup_random_small_alphabet(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab c de f".split()) for _ in range(rng.randint(0, 160))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df, 9).collect()}
    assert [got[i] for i in range(60)] == _kept(texts, 9)


def _groups(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_brute_force(docs):
    rows = docs.select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_tensor.near_duplicates(rows).collect()}
    assert got == _groups([(r.doc_id, r.text) for r in rows.collect()], 2, 80)


def test_near_duplicates_chains_and_odd_rows(spark, odd):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text, rows = list(words[:120]), []
    for i in range(40):   # each a few words from the one before: a chain, not a ball
        rows.append((100 + i, " ".join(text)))
        for _ in range(4):
            text[rng.randrange(len(text))] = rng.choice(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_tensor.near_duplicates(df).collect()}
    assert got == _groups(rows, 2, 80)
    out = minhash_tensor.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by_id[0].n_shingles == 0 and by_id[0].kept and by_id[1].kept
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert minhash_tensor.first_of_each_id(odd).filter("doc_id IS NOT NULL").count() == len(ODD)


def test_licences(spark, odd):
    texts = ["Released under the MIT License.", "xx licensed under the Apache License, Version 2.0. yy",
             "the mit license and the MIT-license, apache license", "Licensed under CC BY-NC 4.0.", None, "",
             "general public license general public license", "mit\nlicense", "All rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' AS labels")
    got = {r.doc_id: r for r in license_index.scan(df).collect()}
    assert [got[i].base_labels for i in range(9)] == ["mit", "apache", "apache,mit", "", "", "", "gpl", "mit", ""]
    assert "mit-notice" in got[0].labels and "apache-2.0" in got[1].labels and got[3].labels == "cc-by-nc-4.0"
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (3, 1, 7)
    assert got[4].n_words == 0 and got[4].first_word is None and got[4].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(license_index.scan(odd).collect()) == odd.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = piece_codec.default_model()
    assert piece_codec.digests(piece_codec.encode_and_decode(none, "text", model)).count() == 0
    assert line_rules.clean_lines(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert minhash_tensor.near_duplicates(none).count() == 0
    assert license_index.scan(none).count() == 0


def test_piece_digests_of_a_document(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    rows = docs.select("doc_id", "text").limit(20)
    got = {r.doc_id: r for r in piece_codec.digests(
        piece_codec.encode_and_decode(rows.withColumn("keep", F.col("text")), "keep", piece_codec.default_model())).collect()}
    for r in rows.collect():
        ids = library.encode(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_survive_cache_generations(table, monkeypatch):
    import random

    import sentencepiece

    monkeypatch.setattr(piece_codec, "CACHE_CHUNKS", 7)
    rng = random.Random(11)
    words = ["the", "cat", "é", "naïve", "123", "  ", "\n", "x-y", "über", "ok."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    enc = piece_codec.Encoder(table)
    for t in texts * 2:
        got = np.frombuffer(enc.encode_text(t), "<i4").tolist()
        assert got == sp.encode(t), t
    assert len(enc) <= 7 and len(enc.older) <= 7
