"""Cross-tokenizer alignment against plain Python counting with the two libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from expband.llm import token_alignment as ta


def test_perfect_hash_is_a_bijection_and_verifies():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 31, 5000))
    parts = ta.part_of(keys, 3)
    h = ta.Hash([(p, *ta.build_part(keys[parts == p], 0.85)) for p in range(3)], 3)
    idx = h.index(keys)
    assert sorted(idx.tolist()) == list(range(len(keys)))
    recent = ta.Recent(h)
    for some in (rng.choice(keys, 9000), keys, rng.choice(keys, 9000)):
        assert (recent.index(some) == h.index(some)).all()
    others = np.setdiff1d(rng.integers(0, 1 << 31, 5000), keys)
    assert (h.index(others) == -1).all()
    assert (ta.Hash([], 1).index(keys[:3]) == -1).all()


def _plain(texts):
    """Token bytes from the libraries' own decoders, ends by walking, counts by a Counter."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    # byte-level decoding of an entry, by the published rule of the alphabet
    alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in alphabet:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1

    def b_bytes(i):
        piece = sp.id_to_piece(i)
        if piece.startswith("<0x") and piece.endswith(">") and len(piece) == 6:
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    per_doc, counts = [], Counter()
    for text in texts:
        if not text:
            per_doc.append(None)
            continue
        raw = (" " + text).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        ab = [bytes(table[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [b_bytes(i) for i in b]
        if b"".join(ab) != raw or b"".join(bb) != raw:
            per_doc.append(None)
            continue
        ends_a, ends_b, x = {}, {}, 0
        for k, t in enumerate(ab):
            x += len(t)
            ends_a[x] = k
        x = 0
        for k, t in enumerate(bb):
            x += len(t)
            ends_b[x] = k
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a[c]], b[ends_b[c]]) for c in cuts]
        counts.update(links)
        groups, pa, pb = [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, a[pa:ends_a[c] + 1])) + "|" + ",".join(map(str, b[pb:ends_b[c] + 1])))
            pa, pb = ends_a[c] + 1, ends_b[c] + 1
        per_doc.append((len(a), len(b), links, ";".join(groups)))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for got in per_doc:
        if got is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, links, g = got
        out.append((na, nb, len(links), len(links), sum(counts[l] == best[l[1]] for l in links),
                    sum(counts[l] for l in links), hashlib.sha256(g.encode()).hexdigest()))
    return out


TEXTS = ["Hello  world <|endoftext|> </s> é中\n\nx", None, "", "Hello  world <|endoftext|> </s> é中\n\nx", "a" * 3000,
         "tab\tand\r\nlines  ", "😀 emoji ́combining", "Hello world", "Hello world again", " lead"]


@pytest.mark.parametrize("max_pairs", [20_000_000, 0])
def test_alignment_equals_plain_python(spark, max_pairs):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                 for r in ta.alignment(df, ta.Config(max_pairs=max_pairs, part_keys=7)).collect())
    want = sorted((i, *w) for (i, _, _), w in zip(rows, _plain([t for _, t, _ in rows])))
    assert got == want


def test_alignment_on_table_equals_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(tuple(r) for r in ta.alignment(docs).collect())
    want = sorted((i, *w) for (i, _), w in zip(rows, _plain([t for _, t in rows])))
    assert got == want


def test_empty_table(spark):
    assert ta.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_aligned_as_one_sequence_equal_each_alone(monkeypatch):
    """Slices of texts, some without tokens or with other bytes, give what ``align`` gives text by text."""
    al = ta.Aligner.of(ta.tokenizer_files(ta.Config()))
    texts = TEXTS + ["x", "odd one", None, "wrong bytes", "", "12 34,5|6;7"]
    real = al.b.encode

    class Other:  # a tokenizer whose tokens of some texts are others: fewer bytes, as many but different ones, none
        def encode(self, text, **kw):
            if isinstance(text, list):
                return [self.encode(t) for t in text]
            return {"odd one": real("odd"), "wrong bytes": real("wrong bytez"), "x": []}.get(text, real(text))

    monkeypatch.setattr(al, "b", Other())
    alone = [al.align(t) for t in texts]
    assert sum(g is None for g in alone) == 7
    for size in (1, 40, 1 << 17):
        monkeypatch.setattr(ta, "SLICE_CHARS", size)
        parts = list(al.align_all(texts))
        keys = np.concatenate([p.keys() for p in parts])
        assert keys.tolist() == [int(k) for g in alone if g for k in g[0][g[2]] * ta.B_IDS + g[1][g[3]]]
        for values, at in ((lambda p: p.na, 0), (lambda p: p.nb, 1), (lambda p: p.links, 2)):
            assert np.concatenate([p.spread(values(p)) for p in parts]).tolist() == [len(g[at]) if g else 0 for g in alone]
        assert [d for p in parts for d in p.digests()] == [
            hashlib.sha256(al.groups_text(*g).encode()).hexdigest() if g else "" for g in alone]
