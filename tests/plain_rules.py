"""Row-at-a-time Python counterpart of the rule layer, for differential tests."""

import math
import re

from expband.functions import lexicon as lx

I = re.IGNORECASE


def number(token):
    token = token.strip().lower()
    return float(token) if token.isdigit() else (
        float(lx.NUMBER_WORDS[token]) if token in lx.NUMBER_WORDS else None)


def mentions(text):
    kept = []
    for kind, pattern in lx.MENTION_FAMILIES:
        for m in re.finditer(pattern, text, I):
            values = [number(g) for g in m.groups()]
            if any(v is None or v > lx.MAX_YEARS for v in values):
                continue
            if re.search(lx.COMPANY_TENURE, text[max(0, m.start() - lx.TENURE_LOOKBACK):m.start()], I):
                continue
            if any(m.end() > k[2] and m.start() < k[3] for k in kept):
                continue
            hi = max(values) if len(values) == 2 else None
            kept.append((min(values), hi, m.start(), m.end(), kind))
    return kept


def first(patterns, text):
    return next((m for m in (re.search(p, text, I) for p in patterns) if m), None)


def education(text):
    for m in re.finditer(lx.EDUCATION_SUBSTITUTE, text, I):
        pair = [number(g) for g in m.groups()]
        if None not in pair:
            return min(pair), m.start(), m.end()
    return None


def sentences(text):
    out, at = [], 0
    for m in list(re.finditer(lx.SENTENCE_BREAK, text)) + [None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((at, end, text[at:end].strip()))
        at = m.end() if m else end
    return out


def snippet(text, start, end):
    found = next((t for s, e, t in sentences(text) if s <= start and end <= e), None)
    if found is None:
        found = text[max(0, start - lx.SNIPPET_BEFORE):start + lx.SNIPPET_AFTER].strip()
    found = found.lstrip(lx.BULLET_STRIP)
    if len(found) > lx.SNIPPET_MAX:
        found = found[:lx.SNIPPET_MAX - 1].rstrip() + "…"
    return found


def in_requirements(text, start):
    head = text[max(0, start - lx.SECTION_LOOKBACK):start].lower()
    rests = [head[head.rindex(k):] for k in lx.SECTION_KEYWORDS if k in head]
    return any(len(r) < lx.SECTION_LOOKBACK and re.search("[:\n]", r[:lx.SECTION_MARK_WITHIN])
               for r in rests)


def band(years):
    return next((b for b, top in ((1, 2), (2, 5), (3, 15)) if years <= top), 4)


def by_table(table, title):
    return next((b for p, b in table if re.search(p, title, I)), None)


def seniority(title):
    numerals = re.findall(lx.TITLE_NUMERAL, title)
    return lx.NUMERAL_BANDS[numerals[-1]] if numerals else by_table(lx.TITLE_SENIORITY, title)


def hit(title, text):
    title, text = title or "", text or ""

    def evidence(start, end):
        return snippet(text, start, end), "requirements" if in_requirements(text, start) else "description"

    found = mentions(text)
    if found:
        ranked = [(m[0] if m[1] is None else float(math.floor((m[0] + m[1]) / 2)), m[2], m) for m in found]
        anchor, _, m = max(ranked, key=lambda r: r[:2])
        b = band(anchor)
        if re.search(lx.STRONG_SENIOR, title, I) and ((b == 3 and anchor >= 10) or (b == 2 and anchor >= 4)):
            b += 1
        return (b, 0.95, "explicit_yoe" if m[1] is None else "explicit_range",
                *evidence(m[2], m[3]), m[0], m[1])
    edu = education(text)
    if edu:
        return (band(edu[0]), 0.90, "education_substitute", *evidence(*edu[1:]), edu[0], None)
    no = first(lx.NEGATIONS, text)
    if no:
        return (1, 0.95, "negation", *evidence(*no.span()), 0.0, None)
    no = first(lx.NEGATIONS, title)
    if no:
        return (1, 0.95, "negation", snippet(title, *no.span()), "title", 0.0, None)
    found = mentions(title)
    if found:
        m = max(found, key=lambda m: (m[0] if m[1] is None else m[1], m[2]))
        return (band(m[0] if m[1] is None else m[1]), 0.95,
                "explicit_yoe" if m[1] is None else "explicit_range",
                snippet(title, m[2], m[3]), "title", m[0], m[1])
    strong = by_table(lx.STRONG_TITLES, title)
    if strong:
        return (strong, 0.92, "strong_title", title, "title", None, None)
    heads = first((lx.MANAGES_PEOPLE, lx.DIRECT_REPORTS), text)
    if heads:
        return (4 if int(heads[1]) >= 10 else 3, 0.65, "management_scope",
                snippet(text, *heads.span()), "description", None, None)
    if seniority(title):
        return (seniority(title), 0.55, "title_seniority", title, "title", None, None)
    return None
