"""Archives, chats, leaks, site quality, language model, pipeline."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from expband.llm import (attention_lm, blocks, chat_log, minhash_tensor, piece_codec, simhash_leaks, site_quality, warc_bundles)
from expband.llm import queries

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------- archives

def _pages(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "x" * 400_000),
            (6, "u", "same\r\n\r\nsame"), (7, "u", "é中"), (8, "u", "same")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest")


def test_records_come_back(spark, tmp_path):
    pages = _pages(spark)
    warc_bundles.write(pages.repartition(2), str(tmp_path / "w"), frame_bytes=1000, bundle_bytes=5000)
    bundles = spark.read.parquet(str(tmp_path / "w"))
    got = {r.record_id: r for r in warc_bundles.resolved(warc_bundles.fetch(bundles)).collect()}
    assert {i: r.refers_to for i, r in got.items()} == {1: 8, 2: 8, 3: 4, 4: None, 5: None, 6: None, 7: None, 8: None}
    for page in pages.collect():
        raw, r = (page.html or "").encode(), got[page.page_id]
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.payload == (raw if r.record_type == "response" else None)
    some = spark.createDataFrame([(5,), (7,), (7,), (99,)], "record_id long")
    assert sorted(r.record_id for r in warc_bundles.fetch(bundles, some).collect()) == [5, 7]


def test_seek_table_leads_to_frames(spark, tmp_path):
    import zstandard

    warc_bundles.write(_pages(spark).coalesce(1), str(tmp_path / "w"), frame_bytes=600)
    row = spark.read.parquet(str(tmp_path / "w")).first()
    archive = bytes(row.archive)
    table = warc_bundles.seek_table(archive)
    assert len(table) > 3
    whole = b"".join(zstandard.ZstdDecompressor().decompress(archive[a:a + n], max_output_size=m) for a, n, m in table)
    reader = zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True)
    assert reader.read() == whole   # any Zstandard reader sees one WARC file
    for e in row.entries:
        start = sum(m for _, _, m in table[:e.frame]) + e.offset
        assert f"<urn:page:{e.record_id}>".encode() in whole[start:start + e.bytes]


def test_archives_of_empty_and_broken_tables(spark, tmp_path):
    pages = _pages(spark)
    warc_bundles.write(pages.filter("false"), str(tmp_path / "w"))
    assert warc_bundles.fetch(spark.read.parquet(str(tmp_path / "w"))).count() == 0
    with pytest.raises(Exception, match="no identifier"):
        warc_bundles.roles(pages.withColumn("page_id", F.lit(None).cast("long"))).collect()


# ---------------------------------------------------------------------- chats

def test_events_fold(spark):
    rows = [(1, 0, 0, "delta", "user", "he"), (1, 1, 0, "delta", "user", "llo"),
            (1, 2, 1, "delta", "assistant", "bad"), (1, 3, 1, "regenerate", "assistant", None),
            (1, 4, 1, "delta", "assistant", "go"), (1, 5, 1, "delta", "assistant", "od"),
            (1, 6, 0, "edit", "user", "bye"), (1, 7, 0, "delta", "user", "!"),
            (1, 8, 2, "delta", "user", "x"), (1, 9, 2, "remove", "user", None),
            (2, 0, 0, "delta", None, None), (None, 0, 0, "edit", "system", "s")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, body string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat_log.fold(events.orderBy(F.desc("seq"))).collect()}
    assert got == {(1, 0): ("user", "bye!"), (1, 1): ("assistant", "good"), (2, 0): ("", ""), (None, 0): ("system", "s")}


def test_render_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "", None, "<s>[INST] user\nx [/INST]</s>", "<", "<</s>", "é\U0001F600", "s>"]
    roles = ["user", "assistant", "system", "a\nb\\n", None, "<s>", "assistant", "assistant", "tool", "assistant"]
    rows = [(k, i, r, t) for k in range(2) for i, (r, t) in enumerate(zip(roles, texts[k:] + texts[:k]))]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    for chat in chat_log.read_back(chat_log.render(messages)).collect():
        want = [(r or "", t or "") for k, _, r, t in rows if k == chat.conv_id]
        assert [(t.role, t.text) for t in chat.turns] == want
        assert chat.loss_text == "".join(t for r, t in want if r == "assistant")


def test_conversations_with_ties_and_repeats(spark, tmp_path):
    rows = [(5, 0, "user", "a" * 1000), (5, 1, "assistant", None), (5, 1, "assistant", "x"), (5, 1, "assistant", "x"),
            (6, None, None, "t"), (None, 2, "assistant", "n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "c"))
    got = {r.conv_id: r for r in chat_log.of_conversations(spark, str(tmp_path / "c")).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {5: 4, 6: 1, None: 1, -7: 2}
    assert got[5].loss_chars == 2 and got[None].loss_chars == 1


def test_conversations_equal_their_rows(spark, sf):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op4_chat_log(spark, sf).collect()}
    assert set(got) == set(turns)
    for i, rows in turns.items():
        said = "".join(f"{r}\n{t}\n" for _, r, t in sorted(rows))
        loss = "".join(t for _, r, t in sorted(rows) if r == "assistant")
        assert got[i].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---------------------------------------------------------------------- leaks

def _words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def _leaks(docs, items, size=5, least=0.8):
    """The best window of each document and item, of all windows that share a shingle in its place."""
    out = {}
    for i, text in docs:
        w = _words(text)
        for j, item in items:
            b = _words(item)
            n = min(len(b), len(w))
            grams = {tuple(b[k:k + size]) for k in range(len(b) - size + 1)}
            places = defaultdict(list)
            for k in range(len(b) - size + 1):
                places[tuple(b[k:k + size])].append(k)
            starts = {max(0, min(p - q, len(w) - n)) for p in range(len(w) - size + 1) for q in places.get(tuple(w[p:p + size]), ())}
            for s in starts:
                own = {tuple(w[k:k + size]) for k in range(s, s + n - size + 1)}
                weight = {g: sum(map(len, g)) for g in own | grams}
                sim = sum(weight[g] for g in own & grams) / sum(weight.values())
                if sim >= least:
                    out[i, j] = max(out.get((i, j), (0, 0)), (round(sim, 6), -s))
    return out


def test_leaks_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.first_word) for r in simhash_leaks.leaks(docs, bench).collect()}
    assert got == _leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"w{k}x" for k in range(60))
    changed = item.replace("w30x", "other").upper()
    docs = [(1, f"start. {item}! end"), (2, changed), (3, None), (4, ""), (5, " ".join(item.split()[:30])), (1, f"start. {item}! end"),
            (None, item), (6, "w1x w2x w3x w4x"), (7, "intro " * 3000 + item), (8, item.replace(" ", "\n- "))]
    items = [(1, item), (2, "too few words"), (3, None), (None, item), (4, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 AS doc_id")
    got = {(r.doc_id, r.item_id) for r in simhash_leaks.leaks(df, bench).collect()}
    assert got == {(d, i) for d in (1, 2, 7, 8) for i in (1, 4)}
    assert simhash_leaks.leaks(df.filter("false"), bench).count() == 0
    assert simhash_leaks.leaks(df, bench.filter("false")).count() == 0


def test_leaks_with_one_long_word_swapped(spark):
    """One long word turns many bits of a fingerprint, and few of the shingles."""
    rng = np.random.default_rng(5)

    def word(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    items, docs = [], []
    for k in range(40):
        words = [word(rng.integers(2, 10)) for _ in range(60)]
        items.append((k, " ".join([*words, word(24)])))
        docs += [(2 * k, " ".join([*words, word(24)])), (2 * k + 1, " ".join([word(24), *words[1:], items[-1][1].split()[-1]]))]
    got = simhash_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, -r.first_word) for r in got} == _leaks(docs, items)
    assert len(got) == len(docs)


def test_leaks_run_without_python(spark, sf, capsys):
    simhash_leaks.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --------------------------------------------------------------- site quality

def test_classifier_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.1")   # a few hundred labels hold too few toxic words to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    test = labels.filter("doc_id % 5 = 0")
    out = site_quality.classify(docs, labels.filter("doc_id % 5 <> 0"), F.col("source"), F.col("lang"))
    rows = out.join(test.withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id").collect()
    assert len(rows) == test.count() > 50
    assert sum((r.quality >= 0.5) == (r.q == 1) for r in rows) >= 0.9 * len(rows)
    assert sum((r.toxic >= 0.5) == (r.t == 1) for r in rows) >= 0.9 * len(rows)


def test_sparse_sites_are_drawn_to_the_prior(spark):
    rows = ([("big", "big/a", float(i % 10 < 9)) for i in range(1000)] + [("bad", "bad/a", 0.0)] * 500
            + [("bad", "bad/b", 0.0)] * 2 + [("one", "one/a", 0.0)] + [("big", "big/b", 0.0)])
    soft = spark.createDataFrame(rows, "host string, path string, quality_soft double").withColumn("toxic_soft", F.lit(0.1))
    sites, share = site_quality.site_posteriors(soft)
    got = {r.path: r for r in sites.collect()}
    assert abs(got["big/a"].quality_path - 0.9) < 0.02 and got["bad/a"].quality_path < 0.02
    assert got["one/a"].quality_path > 0.1                       # one document says little
    assert got["big/b"].quality_path > got["bad/b"].quality_path  # a sparse path follows its host
    assert abs(share["quality"] - 900 / 1504) < 0.01


def test_sites_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "h", "en"), (3, "fine words here " * 9, "h", None), (3, "fine words here " * 9, "h", None),
            (None, "x", "h", "en"), (4, "y " * 4000, "k", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS host", "2 AS kept")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 0), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    out = site_quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(out) == len(rows) and all(r.kept is not None and 0 <= r.quality <= 1 for r in out)
    assert site_quality.classify(docs.filter("false"), labels, F.col("source"), F.col("lang")).count() == 0
    assert len(site_quality.classify(docs, labels.filter("false"), F.col("source"), F.col("lang")).collect()) == len(rows)


# ------------------------------------------------------------- language model

SMALL = attention_lm.Model(symbols=128, classes=24, groups=8, frequent_words=50, train_every=2)


def _unigram(rows):
    def tokens(t):
        return WORD.findall((t or "").translate(LOWER)) + [None]
    train = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 10]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[x] > 0 for x in tokens(t)),
                sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) for _, t in rows]


def test_language_model_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in attention_lm.score(docs, piece_codec.default_model(), SMALL).collect()}
    n, want = _unigram(rows)
    for (i, _), (tokens, known, base) in zip(rows, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert r.score < 0


def test_language_model_beats_the_unigram_on_held_out_texts(spark, sf):
    """With the default model and 10,000 documents; a few hundred are too few for its bigrams."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text")
    held = attention_lm.score(docs, piece_codec.default_model()).filter("held_out")
    score, base = held.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_language_model_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "a c"), (4, "b " * 3000), (5, "\U0001F600 x" * 40), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS train", "2 AS score")
    got = attention_lm.score(docs, piece_codec.default_model(), SMALL).collect()
    n, want = _unigram(rows)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((a, b, round(c, 6)) for a, b, c in want)
    assert attention_lm.score(docs.filter("false"), piece_codec.default_model(), SMALL).count() == 0


@pytest.fixture(scope="module")
def subwords():
    words = ["the", "of", "and", "information", "data", "internationalization", "a", "x", "to", "in"]
    tables = attention_lm.start_tables(words, piece_codec.default_model(), attention_lm.Model())
    return attention_lm.Subwords(tables)


def _trained(subwords, texts):
    """Windows of the texts, and the ids and offsets they are laid over."""
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)), pa.int32())], ["text", "text_mark"])
    with np.errstate(over="ignore"):
        words = blocks.Words(rows.column("text"), lower=True)
        ids, offsets, _ = subwords.of(words, words.hashes())
        return attention_lm._training_windows(rows, words, subwords), ids, offsets


def test_every_run_of_words_is_trained_on(subwords):
    (_, _, mask), _, _ = _trained(subwords, ["the of and a to in data x " * 100, "the of", None])
    assert mask.sum() >= 9 * 80     # ten words each in 80 runs; a later run's first id may not count


def test_each_id_is_a_training_target_once(subwords):
    texts = ["internationalization of information " * 30, "the", "", None, "of the data " * 7]
    (symbols, targets, mask), ids, offsets = _trained(subwords, texts)
    t = subwords.t
    before = np.concatenate(([0], t.symbol[ids[:-1]]))
    before[offsets[:-1]] = t.model.symbols - 1
    assert targets[mask].tolist() == t.group[ids].tolist()
    assert symbols[mask].tolist() == before.tolist()


def test_windows_score_each_id_once_and_sum_to_one():
    m = attention_lm.Model(symbols=16, classes=8, groups=2, window=6, stride=4, width=4)
    rng = np.random.default_rng(1)
    group = np.arange(10) % 8
    tables = attention_lm.Tables(m, b"", np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), 9,
                                 np.arange(10), group, np.arange(10), np.log(np.full((16, 8), 1 / 8)).astype(np.float32),
                                 np.log(np.tile(np.where(np.isin(np.arange(24) % 8, (0, 1)), 0.5, 1.0), (16, 1))).astype(np.float32),
                                 np.zeros(10, np.float32),
                                 attention_lm._begin(m) + rng.normal(0, 0.2, len(attention_lm._begin(m))).astype(np.float32))
    prefix = rng.integers(0, 10, 14)
    for n in (0, 3, 7, 14):
        ids = np.concatenate([np.append(prefix[:n], k) for k in range(10)])
        whole = attention_lm._score(ids, np.arange(11) * (n + 1), tables)
        before = attention_lm._score(prefix[:n], np.array([0, n]), tables)[0] if n else 0.0
        assert abs(sum(10 ** (whole - before)) - 1) < 1e-4


def test_gradient():
    m = attention_lm.Model(symbols=6, classes=4, groups=1, window=5, stride=3, width=3)
    rng = np.random.default_rng(2)
    tables = attention_lm.Tables(m, b"", None, None, None, 0, None, None, None, rng.normal(0, 1, (6, 4)).astype(np.float64))
    theta = rng.normal(0, 0.5, len(attention_lm._begin(m)))
    symbols, targets = rng.integers(0, 6, (3, 5)), rng.integers(0, 4, (3, 5))
    mask = rng.random((3, 5)) < 0.8

    def loss(t):
        w = attention_lm._split(t, m)
        logit = attention_lm._attend(symbols, w)[0] @ w[3] + tables.bigram[symbols]
        logp = logit - np.log(np.exp(logit).sum(2, keepdims=True))
        return -np.take_along_axis(logp, targets[..., None], 2)[..., 0][mask].mean()
    g = attention_lm._step(symbols, targets, mask, tables, theta)
    for k in rng.integers(0, len(theta), 25):
        e = np.zeros(len(theta))
        e[k] = 1e-4
        assert abs((loss(theta + e) - loss(theta - e)) / 2e-4 - g[k]) < 2e-3


def test_steps_share_their_arrays():
    """A batch's gradient doesn't depend on what the arrays held before, also where logits are cut at 60."""
    m = attention_lm.Model(symbols=12, classes=6, groups=2, window=5, stride=3, width=4)
    rng, space = np.random.default_rng(3), attention_lm.Space()
    tables = attention_lm.Tables(m, b"", None, None, None, 0, None, None, None, rng.normal(-2, 1, (12, 6)).astype(np.float32))
    theta = rng.normal(0, 0.5, len(attention_lm._begin(m))).astype(np.float32)
    for n, scale in ((7, 1), (2, 8), (9, 30), (1, 1), (9, 1)):
        symbols, targets, mask = rng.integers(0, 12, (n, 5)), rng.integers(0, 6, (n, 5)), rng.random((n, 5)) < 0.7
        weights = theta * np.float32(scale)
        got = attention_lm._step(symbols, targets, mask, tables, weights, np.exp(tables.bigram), space)
        alone = [attention_lm._step(symbols[i:i + 1], targets[i:i + 1], mask[i:i + 1], tables, weights) * mask[i].sum() for i in range(n)]
        want = np.sum(alone, axis=0) / max(mask.sum(), 1)
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-3, atol=1e-4 * max(1, abs(want).max()))


def test_texts_are_cut_once_for_all_steps(spark):
    """The written rows hold all that counting, training, scoring and rare words need, and no text."""
    import sentencepiece

    rows = [(1, None), (2, ""), (3, "The the ODD information"), (3, "The the ODD information"), (None, "x" * 70 + " the"), (4, "odd " * 3000)]
    docs = attention_lm.prepared(spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    tables = attention_lm.start_tables(["the", "information"], piece_codec.default_model(), SMALL)
    texts = attention_lm.encoded(docs, tables)
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    assert "text" not in texts.columns and texts.count() == len(rows)
    got = sorted((r.doc_id or 0, np.frombuffer(r.ids, np.uint16).tolist(), len(r.listed) // 4,
                  (np.frombuffer(r.listed, np.int32) < 0).sum(), np.frombuffer(r.others_n, np.int32).sum(), len(r.others) // 8)
                 for r in texts.collect())
    want = []
    for i, text in rows:
        words = (text or "").lower().split()
        other = [w for w in words if w not in ("the", "information")]
        want.append((i or 0, [x for w in words for x in pieces.encode(w)] + [pieces.eos_id()], len(words), len(other), len(other), len(set(other))))
    assert got == sorted(want)
    words_n, ids_n, pairs_n = attention_lm.count(texts, tables)
    trained = [x for i, ids, *_ in want if zlib.crc32(str(i).encode()) % 10 and i for x in ids]
    assert words_n[-1] == sum(w[2] + 1 for w in want if w[0] and zlib.crc32(str(w[0]).encode()) % 10)
    assert ids_n.tolist() == np.bincount(trained, minlength=len(ids_n)).tolist() and pairs_n.sum() == len(trained)


# ------------------------------------------------------------------- pipeline

def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == columns, name
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        assert out.filter("n_chars <> length(text)").count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() > 50


def test_pipeline_keeps_good_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    base = queries.op6_line_rules(spark, sf).filter("NOT base_failed")
    good = labels.join(base, "doc_id", "left_semi")
    assert first.join(good, "doc_id", "left_semi").count() == good.count()
    near = corpus_pipeline.near_duplicates(spark, first, sf)
    again = minhash_tensor.near_duplicates(near.select("doc_id", "text"))
    assert again.filter("NOT kept").count() == 0
    assert corpus_pipeline.decontamination(spark, near, sf).join(
        simhash_leaks.leaks(near, spark.read.parquet(f"{sf}/benchmark.parquet")), "doc_id", "left_semi").count() == 0
