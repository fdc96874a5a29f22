"""Rule layer: signals of a posting and the cascade that turns them into a hit.

A plan is a list of stages, each a dict of column name -> SQL expression over the
columns of earlier stages. ``add_columns`` runs a plan as projections, so Catalyst
drops what nobody reads; ``as_scalar`` nests the same plan into one expression for
SQL functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expband.functions import lexicon as lx
from expband.functions import spans as sp

# Confidences of the rules, by rule.
MENTION_CONFIDENCE = 0.95
EDUCATION_CONFIDENCE = 0.90
NEGATION_CONFIDENCE = 0.95
STRONG_TITLE_CONFIDENCE = 0.92
MANAGEMENT_CONFIDENCE = 0.65
SENIORITY_CONFIDENCE = 0.55

MENTION_TYPE = ("array<struct<lo: double, hi: double, start: int, end: int, kind: string>>")
HIT_TYPE = ("struct<label: int, confidence: double, decided_by: string, "
            "evidence_snippet: string, evidence_source: string, "
            "min_years: double, max_years: double>")

SIGNALS = ["x_mentions", "x_title_mentions", "x_negation", "x_title_negation", "x_edu",
           "x_management", "x_senior", "x_executive", "x_strong_title", "x_seniority"]

Stage = dict[str, str]


def years_to_band(years: str) -> str:
    return (f"CASE WHEN {years} <= 2 THEN 1 WHEN {years} <= 5 THEN 2 "
            f"WHEN {years} <= 15 THEN 3 WHEN {years} IS NOT NULL THEN 4 END")


def parse_number(token: str) -> str:
    """Years as double from digits or a number word, null for anything else."""
    digits = (f"translate(tok, {sp.literal(''.join(lx.WIDE_DIGITS))}, "
              f"'{''.join(lx.WIDE_DIGIT_VALUES)}')")
    words = " ".join(f"WHEN '{w}' THEN {n}D" for w, n in lx.NUMBER_WORDS.items())
    ascii_only = "octet_length(tok) = length(tok)"
    value = (f"CASE WHEN tok RLIKE '^[0-9]+$' THEN cast(tok AS double) "
             f"WHEN NOT ({ascii_only}) AND tok RLIKE r'^\\p{{Nd}}+$' "
             f"THEN cast({digits} AS double) "
             f"ELSE CASE tok {words} END END")
    return sp.let("tok", f"lower({sp.strip(token)})", value)


def _first_band(text: str, table: tuple[tuple[str, int], ...]) -> str:
    whens = " ".join(f"WHEN {text} RLIKE {sp.regex(p)} THEN {band}" for p, band in table)
    return f"CASE {whens} END"


def _segments(text: str, odd: str) -> str:
    """Pieces of a text in which a mention, a negation or a headcount can occur."""
    def near(words: tuple[str, ...]) -> str:
        return f"({odd} OR {sp.contains_any('low', words)})"
    years = near(("year", "yr")) + " AND " + near(
        ("exp", "background", "track", "work", "hands"))
    return sp.segments(text, {
        "years": years,
        "denies": near(("experience", "level", "train")),
        "heads": near(("manag", "lead", "oversee", "supervis", "direct")),
    })


def _mentions(text: str, segs: str) -> list[str]:
    """Two steps: all usable mentions in family order, then those without overlap."""
    parts = []
    for kind, pattern in lx.MENTION_FAMILIES:
        quick = pattern if kind == "explicit_min" else lx.number_first(pattern)
        n = [parse_number(f"regexp_extract(s.body, {sp.regex(pattern)}, {g})") for g in (1, 2)]
        lo, hi = n[0], "cast(NULL AS double)"
        if kind == "explicit_range":
            lo = f"CASE WHEN {n[0]} IS NOT NULL AND {n[1]} IS NOT NULL THEN least({n[0]}, {n[1]}) END"
            hi = f"greatest({n[0]}, {n[1]})"
        found = (f"transform({sp.match_spans('g.body', quick)}, s -> named_struct("
                 f"'lo', {lo}, 'hi', {hi}, 'start', g.start + s.start, "
                 f"'end', g.start + s.end, 'kind', '{kind}'))")
        parts.append(f"flatten(transform(places, g -> {found}))")
    begin = f"greatest(m.start - {lx.TENURE_LOOKBACK}, 0)"
    before = f"substring({text}, {begin} + 1, m.start - {begin})"
    usable = (f"coalesce(m.hi, m.lo) <= {lx.MAX_YEARS} AND "
              f"NOT {before} RLIKE {sp.regex(lx.COMPANY_TENURE)}")
    empty = f"cast(array() AS {MENTION_TYPE})"
    first = sp.let("places", f"filter({segs}, g -> g.years)",
                   f"CASE WHEN size(places) = 0 THEN {empty} ELSE "
                   f"filter(concat({', '.join(parts)}), m -> {usable}) END")
    second = (f"CASE WHEN size({{0}}) <= 1 THEN {{0}} ELSE aggregate({{0}}, {empty}, (kept, m) -> "
              "CASE WHEN exists(kept, k -> m.end > k.start AND m.start < k.end) "
              "THEN kept ELSE array_append(kept, m) END) END")
    return [first, second]


def _first_match(segs: str, flag: str, pattern: str) -> str:
    """First segment in which a pattern matches, or null."""
    return f"get(filter({segs}, g -> g.{flag} AND g.body RLIKE {sp.regex(pattern)}), 0)"


def _negation(segs: str) -> str:
    tries = [sp.let("g", _first_match(segs, "denies", p),
                    f"CASE WHEN g IS NOT NULL THEN {sp.first_span('g.body', p, 'g.start')} END")
             for p in lx.NEGATIONS]
    return f"CASE WHEN exists({segs}, g -> g.denies) THEN coalesce({', '.join(tries)}) END"


def _education(text: str) -> str:
    n = [parse_number(f"regexp_extract(s.body, {sp.regex(lx.EDUCATION_SUBSTITUTE)}, {g})")
         for g in (1, 2)]
    rows = (f"transform({sp.match_spans(text, lx.EDUCATION_SUBSTITUTE)}, "
            f"s -> named_struct('first', {n[0]}, 'second', {n[1]}, "
            "'start', s.start, 'end', s.end))")
    best = ("named_struct('years', least(e.first, e.second), 'start', e.start, 'end', e.end)")
    usable = f"get(filter({rows}, e -> e.first IS NOT NULL AND e.second IS NOT NULL), 0)"
    found = sp.let("e", usable, f"CASE WHEN e IS NOT NULL THEN {best} END")
    return (f"CASE WHEN contains({text}, '+') AND {text} RLIKE {sp.regex(lx.EDUCATION_TRIGGER)} "
            f"THEN {found} END")


def _management(segs: str) -> str:
    def count_and_span(pattern: str) -> str:
        n = f"int({parse_number(f'regexp_extract(g.body, {sp.regex(pattern)}, 1)')})"
        hit = sp.let("w", sp.first_span("g.body", pattern, "g.start"),
                     f"named_struct('n', {n}, 'start', w.start, 'end', w.end)")
        return sp.let("g", _first_match(segs, "heads", pattern),
                      f"CASE WHEN g IS NOT NULL THEN {hit} END")
    return (f"CASE WHEN exists({segs}, g -> g.heads) THEN coalesce("
            f"{count_and_span(lx.MANAGES_PEOPLE)}, {count_and_span(lx.DIRECT_REPORTS)}) END")


def _best(mentions: str, anchor: str) -> str:
    """The mention with the largest (anchor, start)."""
    return (f"array_max(transform({mentions}, m -> named_struct('anchor', {anchor}, "
            "'start', m.start, 'end', m.end, 'lo', m.lo, 'hi', m.hi)))")


def signal_stages(title: str = "title", description: str = "description") -> list[Stage]:
    """Everything the rules and the numeric features read from the two texts."""
    numerals = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.NUMERAL_BANDS.items())
    of_title = _mentions("x_title", "x_title_segs")
    of_desc = _mentions("x_desc", "x_segs")
    return [
        {"x_title": f"coalesce({title}, '')", "x_desc": f"coalesce({description}, '')"},
        {"x_title_odd": sp.has_case_alias("x_title"), "x_desc_odd": sp.has_case_alias("x_desc")},
        {
            "x_title_segs": _segments("x_title", "x_title_odd"),
            "x_segs": _segments("x_desc", "x_desc_odd"),
        },
        {
            "x_title_found": of_title[0],
            "x_found": of_desc[0],
            "x_negation": _negation("x_segs"),
            "x_title_negation": _negation("x_title_segs"),
            "x_edu": _education("x_desc"),
            "x_management": _management("x_segs"),
            "x_senior": f"x_title RLIKE {sp.regex(lx.STRONG_SENIOR)}",
            "x_executive": f"x_title RLIKE {sp.regex(lx.EXECUTIVE_TITLE)}",
            "x_strong_title": _first_band("x_title", lx.STRONG_TITLES),
            "x_numeral": "CASE get(reverse(regexp_extract_all(x_title, "
                         f"{sp.regex(lx.TITLE_NUMERAL, ignore_case=False)}, 1)), 0) "
                         f"{numerals} END",
            "x_title_lexicon": _first_band("x_title", lx.TITLE_SENIORITY),
        },
        {
            "x_title_mentions": of_title[1].format("x_title_found"),
            "x_mentions": of_desc[1].format("x_found"),
            "x_seniority": "coalesce(x_numeral, x_title_lexicon)",
        },
    ]


def hit_stages() -> list[Stage]:
    """The cascade over the signals: first rule that applies decides."""
    midpoint = "CASE WHEN m.hi IS NULL THEN m.lo ELSE floor((m.lo + m.hi) / 2) END"
    band = years_to_band("x_best.anchor")
    bumped = (f"CASE WHEN x_senior AND ({band}) = 3 AND x_best.anchor >= 10 THEN 4 "
              f"WHEN x_senior AND ({band}) = 2 AND x_best.anchor >= 4 THEN 3 ELSE {band} END")
    span = ("CASE x_rule WHEN 1 THEN named_struct('start', x_best.start, 'end', x_best.end) "
            "WHEN 2 THEN named_struct('start', x_edu.start, 'end', x_edu.end) "
            "WHEN 3 THEN coalesce(x_negation, x_title_negation) "
            "WHEN 4 THEN named_struct('start', x_title_best.start, 'end', x_title_best.end) "
            "WHEN 6 THEN named_struct('start', x_management.start, 'end', x_management.end) END")
    years_rule = "CASE WHEN {0}.hi IS NOT NULL THEN 'explicit_range' ELSE 'explicit_yoe' END"
    return [
        {
            "x_best": _best("x_mentions", f"cast({midpoint} AS double)"),
            "x_title_best": _best("x_title_mentions", "coalesce(m.hi, m.lo)"),
            "x_rule": "CASE WHEN size(x_mentions) > 0 THEN 1 WHEN x_edu IS NOT NULL THEN 2 "
                      "WHEN coalesce(x_negation, x_title_negation) IS NOT NULL THEN 3 "
                      "WHEN size(x_title_mentions) > 0 THEN 4 "
                      "WHEN x_strong_title IS NOT NULL THEN 5 "
                      "WHEN x_management IS NOT NULL THEN 6 "
                      "WHEN x_seniority IS NOT NULL THEN 7 END",
        },
        {
            "x_span": span,
            "x_in_desc": "x_rule IN (1, 2, 6) OR (x_rule = 3 AND x_negation IS NOT NULL)",
        },
        {
            "x_evidence": "CASE WHEN x_in_desc THEN x_desc ELSE x_title END",
            "x_label": f"CASE x_rule WHEN 1 THEN {bumped} "
                       f"WHEN 2 THEN {years_to_band('x_edu.years')} WHEN 3 THEN 1 "
                       f"WHEN 4 THEN {years_to_band('x_title_best.anchor')} "
                       "WHEN 5 THEN x_strong_title "
                       f"WHEN 6 THEN CASE WHEN x_management.n >= {lx.MANY_REPORTS} "
                       "THEN 4 ELSE 3 END WHEN 7 THEN x_seniority END",
        },
        {
            "hit": "CASE WHEN x_rule IS NOT NULL THEN named_struct("
                   "'label', x_label, "
                   f"'confidence', CASE x_rule WHEN 2 THEN {EDUCATION_CONFIDENCE}D "
                   f"WHEN 3 THEN {NEGATION_CONFIDENCE}D "
                   f"WHEN 5 THEN {STRONG_TITLE_CONFIDENCE}D "
                   f"WHEN 6 THEN {MANAGEMENT_CONFIDENCE}D WHEN 7 THEN {SENIORITY_CONFIDENCE}D "
                   f"ELSE {MENTION_CONFIDENCE}D END, "
                   f"'decided_by', CASE x_rule WHEN 1 THEN {years_rule.format('x_best')} "
                   "WHEN 2 THEN 'education_substitute' WHEN 3 THEN 'negation' "
                   f"WHEN 4 THEN {years_rule.format('x_title_best')} "
                   "WHEN 5 THEN 'strong_title' WHEN 6 THEN 'management_scope' "
                   "WHEN 7 THEN 'title_seniority' END, "
                   "'evidence_snippet', CASE WHEN x_rule IN (5, 7) THEN x_title ELSE "
                   f"{sp.snippet('x_evidence', 'x_span.start', 'x_span.end')} END, "
                   "'evidence_source', CASE WHEN NOT x_in_desc THEN 'title' "
                   "WHEN x_rule <> 6 AND "
                   f"{sp.in_requirements('x_desc', 'x_span.start')} THEN 'requirements' "
                   "ELSE 'description' END, "
                   "'min_years', CASE x_rule WHEN 1 THEN x_best.lo WHEN 2 THEN x_edu.years "
                   "WHEN 3 THEN 0D WHEN 4 THEN x_title_best.lo END, "
                   "'max_years', CASE x_rule WHEN 1 THEN x_best.hi "
                   "WHEN 4 THEN x_title_best.hi END) END",
        },
    ]


def add_columns(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({name: F.expr(sql) for name, sql in stage.items()})
    return df


def as_scalar(stages: list[Stage], result: str) -> str:
    """The plan as one SQL expression for the column ``result``.

    Each stage becomes a struct bound to a name, and reads of its columns go there.
    """
    home: dict[str, str] = {}

    def qualified(sql: str) -> str:
        return re.sub(r"\b\w+\b", lambda m: home.get(m[0], m[0]), sql)
    bound = []
    for i, stage in enumerate(stages):
        fields = ", ".join(f"'{name}', {qualified(sql)}" for name, sql in stage.items())
        bound.append((f"stage_{i}", f"named_struct({fields})"))
        home.update({name: f"stage_{i}.{name}" for name in stage})
    body = qualified(result)
    for name, value in reversed(bound):
        body = sp.let(name, value, body)
    return body


def fence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pass ``columns`` through a one-row generator.

    A filter on a column derived from them would otherwise be pushed below the
    projections and repeat the whole regex work, once per use.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def add_signals(df: DataFrame, title: str = "title",
                description: str = "description") -> DataFrame:
    """Add the signal columns (``x_*``), the shared input of hits and features."""
    df = add_columns(df, signal_stages(title, description))
    keep = [c for c in df.columns if not c.startswith("x_")]
    return fence(df.select(*keep, "x_title", "x_desc", *SIGNALS), SIGNALS)


def drop_signals(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("x_")])


def rule_hits(df: DataFrame, title: str = "title",
              description: str = "description") -> DataFrame:
    """Add ``hit``: the nullable rule hit struct of each posting."""
    return drop_signals(add_columns(add_signals(df, title, description), hit_stages()))


def mention_stages(text: str) -> list[Stage]:
    steps = _mentions("x_text", "x_segs")
    return [
        {"x_text": f"coalesce({text}, '')"},
        {"x_odd": sp.has_case_alias("x_text")},
        {"x_segs": _segments("x_text", "x_odd")},
        {"x_found": steps[0]},
        {"x_mentions": steps[1].format("x_found")},
    ]


def mentions(df: DataFrame, text: str, out: str = "mentions") -> DataFrame:
    """Add ``out``: the years mentions of one text column, as an array of structs."""
    found = add_columns(df, mention_stages(text)).withColumn(out, F.col("x_mentions"))
    return fence(drop_signals(found), [out])


def sentences(df: DataFrame, text: str, out: str = "sentences") -> DataFrame:
    return fence(df.withColumn(out, F.expr(sp.sentences(f"coalesce({text}, '')"))), [out])
