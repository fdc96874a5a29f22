"""SQL text for locating regex matches, sentences and snippets in a string.

Every helper takes SQL expressions and returns a SQL expression, so that the same
definition serves DataFrame columns (``F.expr``) and SQL functions. Offsets are
0-based, half-open and count code points.
"""

from __future__ import annotations

from expband.functions import lexicon as lx

BLOCK = 64
MARK, STAND_IN = "\x01", "\x02"


def literal(text: str) -> str:
    """A SQL string literal; everything but plain ASCII is written as an escape."""
    out = []
    for ch in text:
        if ch in "'\\":
            out.append("\\" + ch)
        elif 32 <= ord(ch) < 127:
            out.append(ch)
        elif ord(ch) < 0x10000:
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(f"\\U{ord(ch):08x}")
    return "'" + "".join(out) + "'"


def regex(pattern: str, ignore_case: bool = True) -> str:
    """A raw SQL literal holding the JVM form of a pattern."""
    return "r'" + lx.jvm_regex(pattern, ignore_case).replace("'", r"\x27") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strip(text: str) -> str:
    return f"trim(BOTH {literal(lx.SPACES)} FROM {text})"


def contains_any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {literal(w)})" for w in words) + ")"


def has_case_alias(text: str) -> str:
    """True if a letter beyond ASCII occurs that matches an ASCII letter case-blind.

    Lower-casing does not map these letters, so a word search in the lower-cased text
    may only rule a word out if none of them occurs.
    """
    return f"(octet_length({text}) > length({text}) AND {contains_any(text, lx.CASE_ALIASES)})"


def prefix_sums(lengths: str) -> str:
    """Sum of all earlier elements, per element of an int array.

    Folds blocks of fixed size, because appending to one growing array would copy it
    at every step and cost quadratic time on very long texts.
    """
    sums = (f"transform(sequence(0, int((size(sizes) - 1) div {BLOCK})), "
            f"b -> aggregate(slice(sizes, b * {BLOCK} + 1, {BLOCK}), 0, (s, v) -> s + v))")
    fold = (f"aggregate(slice(sizes, b * {BLOCK} + 1, {BLOCK}), "
            "named_struct('pos', aggregate(slice(block_sums, 1, b), 0, (s, v) -> s + v), "
            "'done', cast(array() AS array<int>)), "
            "(a, v) -> named_struct('pos', a.pos + v, 'done', array_append(a.done, a.pos)), "
            "a -> a.done)")
    blocks = f"flatten(transform(sequence(0, size(block_sums) - 1), b -> {fold}))"
    return let("sizes", lengths, let("block_sums", sums, blocks))


def cut_at_matches(text: str, pattern: str) -> str:
    """``array<string>``: gap, match, gap, match, ..., gap; joined they give the text.

    One regex pass marks the matches with a control character. Where the text holds
    that character itself, another one without meaning to any pattern stands in.
    """
    marked = (f"regexp_replace(replace({text}, {literal(MARK)}, {literal(STAND_IN)}), "
              f"{regex(pattern)}, {literal(MARK + '$0' + MARK)})")
    return f"split({marked}, {literal(MARK)}, -1)"


def match_spans(text: str, pattern: str) -> str:
    """``array<struct<start, end, body>>`` of all matches, in text order.

    No engine function returns positions, so they come from the lengths of the pieces.
    """
    row = ("named_struct('start', starts[2 * i - 1], 'end', starts[2 * i - 1] + "
           "length(pieces[2 * i - 1]), 'body', pieces[2 * i - 1])")
    located = let("starts", prefix_sums("transform(pieces, v -> length(v))"),
                  f"transform(sequence(1, int(size(pieces) div 2)), i -> {row})")
    return let("pieces", cut_at_matches(text, pattern),
               f"CASE WHEN size(pieces) > 1 THEN {located} ELSE "
               "cast(array() AS array<struct<start: int, end: int, body: string>>) END")


def first_span(text: str, pattern: str, offset: str) -> str:
    """``struct<start, end>`` of the first match, shifted by ``offset``."""
    start = f"{offset} + length(pieces[0])"
    return let("pieces", cut_at_matches(text, pattern),
               f"CASE WHEN size(pieces) > 1 THEN named_struct('start', {start}, "
               f"'end', {start} + length(pieces[1])) END")


def segments(text: str, flags: dict[str, str]) -> str:
    """``array<struct<start, body, flag...>>``: the pieces of a text that may matter.

    Cuts behind characters that no pattern of the sentence-bound rules can cross and
    keeps the pieces with a true flag; a flag is a test on the lower-cased piece
    ``low``. The costly patterns then see a small part of the text. A test that fails
    on the whole text can't hold on a piece: it is not tried on any, and a text that
    fails all of them is not cut at all.
    """
    whole = let("low", f"lower({text})", "named_struct(" + ", ".join(
        f"'{name}', {test}" for name, test in flags.items()) + ")")
    tested = ", ".join(f"'{name}', whole.{name} AND ({test})" for name, test in flags.items())
    row = ("named_struct('start', s, 'body', p, " + tested + ")")
    rows = f"zip_with(starts, pieces, (s, p) -> {let('low', 'lower(p)', row)})"
    wanted = " OR ".join(f"r.{name}" for name in flags)
    kept = ", ".join(f"'{name}', r.{name}" for name in flags)
    restore = (f"named_struct('start', r.start, 'body', "
               f"substring({text}, r.start + 1, length(r.body) + 1), {kept})")
    found = let("pieces", f"split({text}, {regex(lx.HARD_BREAK, ignore_case=False)}, -1)",
                let("starts", prefix_sums("transform(pieces, p -> length(p) + 1)"),
                    f"transform(filter({rows}, r -> {wanted}), r -> {restore})"))
    some = " OR ".join(f"whole.{name}" for name in flags)
    none = ("cast(array() AS array<struct<start: int, body: string, "
            + ", ".join(f"{name}: boolean" for name in flags) + ">>)")
    return let("whole", whole, f"CASE WHEN {some} THEN {found} ELSE {none} END")


def sentences(text: str) -> str:
    """``array<struct<start, end, text>>``: stripped sentences with unstripped offsets."""
    body = (f"CASE WHEN contains({text}, {literal(MARK)}) "
            f"THEN substring({text}, starts[2 * i] + 1, length(pieces[2 * i])) "
            "ELSE pieces[2 * i] END")
    row = ("named_struct('start', starts[2 * i], 'end', starts[2 * i] + length(pieces[2 * i]), "
           f"'text', {strip(body)})")
    located = (f"filter(transform(sequence(0, int((size(pieces) - 1) div 2)), i -> {row}), "
               "r -> r.text <> '')")
    return let("pieces", cut_at_matches(text, lx.SENTENCE_BREAK),
               let("starts", prefix_sums("transform(pieces, v -> length(v))"), located))


def snippet(text: str, start: str, end: str) -> str:
    """The sentence around ``[start, end)``, or a fixed window if a break lies inside.

    Only the breaks next to the span matter: the last one before it and the first
    one at or after its start (a span never starts with a break character).
    """
    p = regex(lx.SENTENCE_BREAK)
    head = f"element_at(split(left({text}, {start}), {p}, -1), -1)"
    tail = f"get(split(substring({text}, {start} + 1), {p}, 2), 0)"
    begin = f"greatest({start} - {lx.SNIPPET_BEFORE}, 0)"
    window = f"substring({text}, {begin} + 1, {start} + {lx.SNIPPET_AFTER} - {begin})"
    sentence = let("rest", tail, f"CASE WHEN length(rest) >= {end} - {start} "
                                 f"THEN concat({head}, rest) ELSE {window} END")
    bare = f"trim(LEADING {literal(lx.BULLET_STRIP)} FROM {strip(sentence)})"
    cut = f"trim(TRAILING {literal(lx.SPACES)} FROM left(line, {lx.SNIPPET_MAX - 1}))"
    return let("line", bare, f"CASE WHEN length(line) > {lx.SNIPPET_MAX} "
                             f"THEN concat({cut}, {literal('…')}) ELSE line END")


def in_requirements(text: str, start: str) -> str:
    """True if a section keyword opens a section shortly before ``start``.

    Counts the last occurrence of each keyword in the lookback window, if a colon or
    newline follows within the marked distance of the keyword's start.
    """
    begin = f"greatest({start} - {lx.SECTION_LOOKBACK}, 0)"
    head = f"lower(substring({text}, {begin} + 1, {start} - {begin}))"
    words = ", ".join(literal(k) for k in lx.SECTION_KEYWORDS)
    near = f"left(rest, greatest({lx.SECTION_MARK_WITHIN} - length(k), 0))"
    opened = (f"length(rest) + length(k) < {lx.SECTION_LOOKBACK} AND "
              rf"(contains({near}, ':') OR contains({near}, '\n'))")
    test = ("contains(head, k) AND "
            + let("rest", "substring_index(head, k, -1)", opened))
    return let("head", head, f"exists(array({words}), k -> {test})")
