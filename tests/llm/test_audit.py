"""Filter interaction audit against plain Python over all orders."""

import re
from collections import defaultdict
from itertools import permutations

from expband.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0D]+")


def _brute(docs, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for doc_id, quality, tox in labels:
        good[doc_id] |= quality == 1
        toxic[doc_id] |= tox == 1
    first = {}
    for doc_id, text, _ in docs:
        t = text or ""
        if doc_id is not None:
            first[t] = min(first.get(t, doc_id), doc_id)
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": len(set(w)) * 100 < len(w) * 80,
                 "C": sum("A" <= c <= "Z" for c in t) * 100 > len(t) * 10,
                 "D": any(c in "#$%&*|" for c in t),
                 "E": doc_id is not None and doc_id > first[t]}
        rows.append((lang or "", fails, bool(good.get(doc_id)), bool(toxic.get(doc_id))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shap = defaultdict(int)
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                removed = [r for i, r in enumerate(mine) if i not in gone and r[1][f]]
                ids = {i for i, r in enumerate(mine) if i not in gone and r[1][f]}
                red = sum(1 for i, r in enumerate(mine) if i in gone and r[1][f])
                uniq = sum(1 for r in mine if r[1][f] and sum(r[1].values()) == 1)
                gone |= ids
                out[(part, "".join(order), step)] = [len(mine) - len(gone), len(removed), red, uniq,
                                                      sum(r[2] for r in removed), sum(r[3] for r in removed)]
                shap[f] += len(removed)
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shap[o[s - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                               r.shapley) for r in df.collect()}


def test_audit_equals_plain_python(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, None, None), (4, "", "en"), (5, "A B C $ x", "fr"),
            (6, "HELLO world " * 60, "fr"), (None, long, "en"), (7, long + " |", "en"), (8, "x " * 120, "en"),
            (9, "é中 " * 101, None), (0, long, "de")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (5, 1, 1), (6, 0, 1), (9, 1, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'clash' AS mask", "99 AS part")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS good", "2 AS n")
    got = _got(filter_audit.audit(d, l))
    want = _brute(docs, labels)
    assert len(got) == 4 * 600
    assert got == want


def test_audit_of_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    l = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d, l).count() == 0


def test_audit_on_table_equals_plain_python(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = _got(filter_audit.of_documents(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet"))
    assert got == _brute(docs, labels)
