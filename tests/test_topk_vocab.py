"""The threshold vocabulary equals the plain aggregate, ties and repeated rows included."""

import random

from pyspark.sql import functions as F

from expband.operators import textfeat, topk_vocab


def _plain(df, min_df, k):
    return textfeat.vocabulary(textfeat.term_statistics(df, "t"), min_df, k).collect()


def _arrays(spark, rows, parts):
    return spark.createDataFrame([(r,) for r in rows], "t array<string>").repartition(parts)


def test_equals_plain_aggregate_with_ties(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(3000):
        n = rng.randint(0, 30)
        # a steep law: a few frequent terms, many ties among rare ones
        rows.append([words[min(int(rng.paretovariate(0.8)) - 1, 399)] for _ in range(n)])
    rows += [None, [], [None, "w1", None]] + [rows[7]] * 20
    df = _arrays(spark, rows, 8)
    for min_df, k in ((1, 10), (2, 25), (3, 60), (1, 1000)):
        got = topk_vocab.vocabulary(df, "t", min_df, k).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in _plain(df, min_df, k)], (min_df, k)


def test_bound_prunes_rare_terms(spark):
    rows = [["hot", "warm", f"rare{i}"] + ["hot"] * 5 for i in range(4000)]
    df = _arrays(spark, rows, 4)
    need = -(-topk_vocab.floor_count(topk_vocab.bounds(df, "t", 2), 1, 2) // 4)
    assert need > 1
    got = topk_vocab.vocabulary(df, "t", 1, 2).collect()
    assert [(r.term, r.df, r.cf) for r in got] == [("hot", 4000, 24000), ("warm", 4000, 4000)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "t array<string>")
    assert topk_vocab.vocabulary(df, "t", 1, 5).collect() == []


def test_query_equals_plain_query(spark, sf):
    from expband.plans import catalog
    a = sorted(map(tuple, catalog.vocab_bounds(spark, sf).collect()))
    b = sorted(map(tuple, catalog.word_ngrams_df(spark, sf).collect()))
    assert a == b and len(a) > 0


def test_a_task_counts_in_sites_of_bounded_size(spark):
    """One task of many distinct terms ends sites as they fill up; no bound, no text twice, same result."""
    rng = random.Random(9)
    rows = [["hot", "warm", "hot"] + [f"t{rng.randint(0, 200_000)}" for _ in range(20)] for _ in range(2000)]
    df = _arrays(spark, rows, 1)
    counts = topk_vocab.local_counts(df, "t", 10, site_terms=500)
    sizes = [r["count"] for r in counts.groupBy("site").count().collect()]
    assert len(sizes) > 3 and max(sizes) <= 500 + 10_000   # a site ends with the batch that fills it
    assert counts.agg(F.sum("cf")).first()[0] == sum(map(len, rows))
    for min_df, k in ((1, 2), (2, 50)):
        got = topk_vocab.vocabulary(df, "t", min_df, k, site_terms=500).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in _plain(df, min_df, k)]


def test_statistics_mark_nulls_and_repeats(spark):
    df = _arrays(spark, [["b", "a", "b"], [None, None, "a"], None, [], ["a", "a"]], 2)
    got = {r.term: (r.df, r.cf) for r in textfeat.term_statistics(df, "t").collect()}
    assert got == {"a": (3, 4), "b": (1, 2)}
