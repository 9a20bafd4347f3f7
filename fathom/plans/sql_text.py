"""Fragments of DuckDB SQL that say what fathom.functions.text says, for the oracles."""

from __future__ import annotations

from fathom.functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(x: str, pattern: str) -> str:
    """Word boundaries of RE2 know ASCII only, so those next to words are spelled out."""
    if pattern.startswith(r"\b") and pattern.endswith(r"\b"):
        pattern = rf"(?:^|[^\pL\pN_])(?:{pattern[2:-2]})(?:$|[^\pL\pN_])"
    return f"regexp_matches({x}, {quoted(pattern)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normalize(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '\\r\\n?', chr(10), 'g')"
    t = f"translate({t}, chr(160) || chr(127), '  ')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n+', chr(10), 'g')"
    return strip(t)


def tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '\\S+')"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def alpha_ratio(x: str) -> str:
    count = lambda c: f"length(regexp_replace({x}, '[^{c}]', '', 'g'))"
    return f"coalesce({count('A-Za-z')} / nullif({count('A-Za-z0-9')}, 0), 0.0)"


def term_tables(source: str) -> str:
    """Common tables from a table source (id, kind, text) to tt (id, kind, terms): all simple terms in order."""
    stop, priority = ", ".join(quoted(w) for w in T.STOP_WORDS), " OR ".join(f"contains(x, {quoted(k)})" for k in T.PRIORITY_PHRASES)
    return f"""
tw AS (SELECT id, kind, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:-[a-z]+)?|\\d+(?:\\.\\d+)?|°'), lambda t: NOT list_contains([{stop}], t) AND length(t) > 2) AS w FROM {source}),
tp AS (SELECT *, list_filter(list_transform(range(1, greatest(len(w), 1)), lambda i: CASE WHEN regexp_full_match(w[i], '[a-z]+') AND regexp_full_match(w[i + 1], '[a-z]+') THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL) AS pairs FROM tw),
ta AS (SELECT id, kind, list_concat(list_concat(list_filter(pairs, lambda x: {priority}), pairs), w) AS items FROM tp),
tt AS (SELECT id, kind, list_filter(items, lambda x, i: list_position(items, x) = i) AS terms FROM ta)"""


def is_heading(line: str) -> str:
    """line must be stripped."""
    rejected = " OR ".join(matches(line, p) for p in T.HEADING_REJECTS)
    accepted = " OR ".join(matches(line, p) for p in T.HEADING_ACCEPTS)
    return f"({line} <> '' AND NOT ({rejected}) AND ({accepted} OR (contains({line}, ' ') AND {matches(line, T.CAPITALS)})))"


def is_noise(line: str) -> str:
    """line must be stripped."""
    return f"({' OR '.join(matches(line, p) for p in T.NOISE)} OR (contains(lower({line}), 'www.') AND regexp_matches({line}, {quoted(T.NOISE_WITH_WWW)})))"


def chunk_kind(section: str, text: str) -> str:
    title, low = f"lower({strip(f"coalesce({section}, '')")})", f"lower({text})"
    cases = []
    for where, kind, pattern in T.KIND_RULES:
        if where == "inspection":
            fits = f"contains({low}, 'inspection') AND {matches(low, pattern)}"
        elif pattern == r"\bif\b.*\bthen\b":
            fits = f"regexp_matches({low}, '(?:^|[^\\pL\\pN_])if(?:[^\\pL\\pN_]|[^\\pL\\pN_].*[^\\pL\\pN_])then(?:$|[^\\pL\\pN_])')"
        elif pattern.endswith(r":)\b"):  # a boundary after a colon asks for a letter or digit behind it
            fits = f"regexp_matches({low}, '(?:^|[^\\pL\\pN_]){pattern[2:-2]}[\\pL\\pN_]')"
        elif pattern.startswith(r"\b\d"):
            fits = f"regexp_matches({text}, '(?:^|[^\\pL\\pN_])\\d{{1,3}}\\)\\s')"
        else:
            fits = matches({"section": title, "text": text, "lower": low}[where], pattern)
        cases.append(f"WHEN {fits} THEN '{kind}'")
    return f"CASE {' '.join(cases)} ELSE 'other' END"
