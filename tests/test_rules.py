"""Rule layer: stated cases, and random texts against the plain Python counterpart."""

import plain_rules
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from expband.functions import rules, signals, sql
from expband.sources import fixtures as fx

WORDS = [
    "5", "3", "12", "60", "2015", "ten", "Sixteen", "six", "zero", "٣", "²", "+", "+ ", "-", "–", " to ",
    "years", "year", "yrs", "yrs.", "yr", " of ", "experience", "exp.", "exp", "hands-on", "background",
    "track record", "with ", "for ", "for over ", "at least ", "Minimum of ", "min. ", "requires ",
    "must have ", "(four) ", "(a. b) ", "combined ", "service ", "old ", "age ", "sales ", "Java/C++, ",
    "no ", "prior ", "experience necessary", "entry-level position", "this is an entry level",
    "we'll train you", "we will train the right", "on-the-job training provided", "Bachelor degree",
    "MBA", " or ", "manages ", "a team of ", "engineers", "direct reports", "supervises 4 employees",
    "Requirements:", "qualifications\n", "what you'll need", "you have", ". ", ".", "! ", "? ", ": ",
    "\n", "\n- ", "• ", "* ", "  ", "\t", " ", "\u001c", "\x01", "\x02", "é", "é", "😀", "ſ",
    "K", "İ", "ı", "experıence", "yearſ", "/", "$", "_", "x" * 45, "we have been ", "our company ", ",", ";",
]
TITLES = ["", "Senior Analyst", "CEO", "VP of Engineering II", "Engineer III", "Technician ii", "x_II",
          "sr. dev", "Sr.dev", "Summer Associate", "co-op", "Team Lead, 5+ years experience", "éII IV",
          "no experience necessary", "Head of Growth", "Chief Technology Officer", "associate i", "MGR",
          "Directoŕ", "principal", "1-3 years exp 7+ yrs exp", "Intern", "chief\u001cx officer"]
TEXT = st.lists(st.sampled_from(WORDS), max_size=14).map("".join)
SPACED = st.lists(st.sampled_from(WORDS), max_size=14).map(" ".join)


def collect(df):
    return [tuple(r) if r is not None else None for r in (row[0] for row in df.collect())]


@settings(max_examples=4, deadline=None, phases=[Phase.generate],
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(TITLES), st.one_of(TEXT, SPACED)), min_size=150, max_size=250))
def test_hits_and_mentions_equal_plain_python(spark, rows):
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(rows)],
                               "id int, title string, description string").coalesce(4)
    got = {r.id: r for r in rules.mentions(rules.rule_hits(df), "description").select(
        "id", "hit", "mentions").collect()}
    for i, (title, text) in enumerate(rows):
        assert [tuple(m) for m in got[i].mentions] == plain_rules.mentions(text), repr(text)
        hit = got[i].hit
        assert (tuple(hit) if hit else None) == plain_rules.hit(title, text), (title, text)


@settings(max_examples=2, deadline=None, phases=[Phase.generate],
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(TEXT, SPACED), min_size=150, max_size=250))
def test_sentences_equal_plain_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in rules.sentences(df, "text").collect():
        assert [tuple(s) for s in r.sentences] == plain_rules.sentences(texts[r.id])


def hits(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, title string, description string")
    return [r.hit for r in rules.rule_hits(df).orderBy("id").collect()]


@pytest.mark.parametrize("k", range(len(fx.TEMPLATES)))
def test_templates_have_their_expected_band(spark, sf, k):
    if not hasattr(test_templates_have_their_expected_band, "bands"):
        rows = [("", t) for t in fx.TEMPLATES]
        test_templates_have_their_expected_band.bands = [h and h.label for h in hits(spark, *rows)]
    got = test_templates_have_their_expected_band.bands[k]
    assert (got or 0) == fx.TEMPLATE_BANDS[k]


def test_stated_edge_cases(spark):
    long = "5 years of experience " + "word " * 60 + "end"
    rows = [
        ("", "10 years of combined experience"),            # the guard leaks for plurals
        ("", "10 year of combined experience"),             # and holds for singulars
        ("", "with 5+ years experience"),                   # read as company tenure
        ("", "2015-20 years experience"),                   # no left boundary on ranges
        ("", "no experience required. 8 years experience"),  # years beat the negation
        ("CEO", "1 year experience"),
        (None, None),
        ("", long),
        ("", "Requirements: " + "a" * 1500 + " 5 years experience"),
        ("", "-- 5 years experience"),
        ("", "15 years experience"),
        ("", "٣ years experience"),
    ]
    got = hits(spark, *rows)
    assert [h and h.label for h in got] == [3, None, None, 4, 3, 1, None, 2, 2, 2, 3, 2]
    assert (got[3].min_years, got[3].max_years) == (15.0, 20.0)
    assert len(got[7].evidence_snippet) == 200 and got[7].evidence_snippet.endswith("…")
    assert got[8].evidence_source == "description"
    assert got[9].evidence_snippet == "5 years experience"


def test_very_long_text_keeps_offsets(spark):
    text = "Plain words here. " * 20000 + "We want 7 years of experience. " + "More. " * 1000
    df = spark.createDataFrame([("", text)], "title string, description string")
    m = rules.mentions(df, "description").first().mentions
    assert [tuple(x) for x in m] == plain_rules.mentions(text)
    many = "5 years experience. " * 500
    df = spark.createDataFrame([(many,)], "description string")
    assert len(rules.mentions(df, "description").first().mentions) == 500


def test_filter_on_a_hit_does_not_repeat_the_scan(spark, sf):
    df = rules.rule_hits(fx.postings(spark, sf)).filter("hit.label = 3 AND hit.confidence > 0.5")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[.!?:•*](?<!") == 2


def test_numeric_features_of_a_known_posting(spark):
    text = "Note.\n- 3 to 5 years of sales experience.\n• 7+ years experience\n+ a\nSupervises 4 employees"
    df = spark.createDataFrame([("Engineer II", text)], "title string, description string")
    r = signals.numeric_features(df).first().asDict()
    assert [r[c] for c in signals.NUMERIC_FEATURES] == [
        7.0, 3.0, 5.0, 2.0, 1.0, 0.0, 0.0, 0.0, 1.0, 4.0, 2.0, 1.0,
        float(len(text)), float(len(text.split())), 2.0, 3.0]


def test_sql_functions_equal_columns(spark, sf):
    sql.register(spark)
    p = fx.postings(spark, sf)
    p.createOrReplaceTempView("p")
    a = spark.sql("SELECT job_id, yoe_hit(title, description) AS hit, "
                  "yoe_mentions(description) AS mentions FROM p")
    b = rules.mentions(rules.rule_hits(p), "description").select("job_id", "hit", "mentions")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    bands = spark.sql("SELECT yoe_band(2D), yoe_band(2.5D), yoe_band(15D), yoe_band(15.1D)").first()
    assert list(bands) == [1, 2, 3, 4]
