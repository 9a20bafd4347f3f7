"""Text expressions: columns in, columns out, all inside Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a line a heading, a line noise, or a chunk a kind. Patterns marked i are read without case.
HEADING_REJECTS = (
    r"\.{5,}\s*\d+\s*$",
    r"^\d+(\.\d+)*\s*\(\d{4}[-/]\d{2}[-/]\d{2}\)",
    r"^\d{4}[-/]\d{2}[-/]\d{2}\b",
    r"^\d{1,2}[./]\d{1,2}[./]\d{2,4}\b",
    r"^\d{6,10}$",
    r"(?i)^page\s+\d+(\s+of\s+\d+)?$",
    r"^[A-Z]{2,}(?:-[A-Z0-9]{2,}){2,}$",
    r"(?i)^(figure|fig\.|table|tab\.)\b",
)
HEADING_ACCEPTS = (
    r"^\d+(\.\d+)*\s+\S+",
    r"^[IVXLCDM]+\.\s+\S+",
    r"^[A-Z]\.\s+\S+",
    r"(?i)^(element|lesson|tab\.?|table|figure|fig\.?)\b",
)
CAPITALS = r"^[A-Z0-9][A-Z0-9 \-:/()&,]{5,}$"
NOISE = (r"^$", r"(?i)^page\s+\d+(\s+of\s+\d+)?$", r"^\d+\s*/\s*\d+$", r"^\d{6,10}$")
NOISE_WITH_WWW = r"\b\d+\s*/\s*\d+\b"
#: In order: where (section, text as it is, or text in lower case), kind, alternatives between word boundaries.
_DEFINITIONS = "terms and definitions|definitions|abbreviations|glossary"
_CHANGES = "change log|revision history|document control|version history|revision table"
_TRAINING = "training|course|module|certification|participant|instructor"
KIND_RULES = (
    ("section", "procedure", r"\b(procedure|work instruction|step-by-step|step by step)\b"),
    ("section", "checklist", r"\b(checklist|check list)\b"),
    ("section", "troubleshooting", r"\b(troubleshooting|trouble shooting)\b"),
    ("section", "safety", r"\b(safety|stop criteria)\b"),
    ("section", "inspection", "inspection"),
    ("lower", "procedure", r"\bstep-by-step\b"),
    ("text", "procedure", r"\b\d{1,3}\)\s"),
    ("lower", "procedure", r"\bif\b.*\bthen\b"),
    ("lower", "troubleshooting", r"\b(symptom:|likely causes:|checks:|actions:)\b"),
    ("lower", "troubleshooting", "troubleshooting"),
    ("lower", "checklist", r"\b(checklist|check list)\b"),
    ("lower", "safety", r"\b(do not operate|stop criteria|warning|caution|hazard|ppe|lockout|loto)\b"),
    ("inspection", "inspection", r"\b(objective|frequency|method|requirements|criteria)\b"),
    ("section", "definition", rf"\b({_DEFINITIONS})\b"),
    ("lower", "definition", rf"\b({_DEFINITIONS})\b"),
    ("section", "changelog", rf"\b({_CHANGES})\b"),
    ("lower", "changelog", rf"\b({_CHANGES})\b"),
    ("section", "training_admin", rf"\b({_TRAINING})\b"),
    ("lower", "training_admin", rf"\b({_TRAINING})\b"),
)
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "with", "for", "is", "are", "was", "were")
PRIORITY_PHRASES = ("leading edge", "trailing edge", "yaw misalignment", "pitch angle", "power deficit", "power residual", "blade crack")


#: Every character with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(c: Column) -> Column:
    """White space of any kind goes from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalize(c: Column) -> Column:
    """Line ends become LF, no-break spaces and DEL become spaces, runs shrink to one, ends are stripped; null is empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    t = F.translate(t, "\u00a0\u007f", "  ")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n+", "\n")
    return strip(t)


def tokens(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), 0)


def token_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"))


def terms(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, for ranking."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def alpha_ratio(c: Column) -> Column:
    """ASCII letters over ASCII letters and digits; 0 if there are none."""
    alnum = F.regexp_count(c, F.lit("[A-Za-z0-9]"))
    return F.coalesce(F.regexp_count(c, F.lit("[A-Za-z]")) / F.nullif(alnum, F.lit(0)), F.lit(0.0))


def is_heading(line: Column) -> Column:
    s = strip(line)
    rejected = any_of([s.rlike(p) for p in HEADING_REJECTS])
    accepted = any_of([s.rlike(p) for p in HEADING_ACCEPTS]) | (s.contains(" ") & s.rlike(CAPITALS))
    return (s != "") & ~rejected & accepted


def is_noise(line: Column) -> Column:
    s = strip(line)
    return any_of([s.rlike(p) for p in NOISE]) | (F.lower(s).contains("www.") & s.rlike(NOISE_WITH_WWW))


def without_noise(text: Column) -> Column:
    """A text whose noise lines are empty, by one expression over all of it; the tests of is_noise by line."""
    space = r"(?U:[^\S\n]*)"
    tests = [p.removeprefix("(?i)").removeprefix("^").removesuffix("$").replace(r"\s", r"[^\S\n]") for p in NOISE]
    www = NOISE_WITH_WWW.replace(r"\s", r"[^\S\n]")
    line = rf"{space}(?:{'|'.join(tests)}){space}"
    without = lambda lines: F.regexp_replace(text, f"(?dmi)^(?:{lines})$", "")
    # few texts name a site, and only these are looked through for one
    return F.when(F.lower(text).contains("www."), without(rf"{line}|(?=[^\n]*www\.)(?=[^\n]*{www})[^\n]*")).otherwise(without(line))


def chunk_kind(section: Column, text: Column) -> Column:
    """The kind that the first fitting rule names, else other."""
    title, raw = F.lower(strip(F.coalesce(section, F.lit("")))), F.coalesce(text, F.lit(""))
    low = F.lower(raw)
    out = F.lit("other")
    for where, kind, pattern in reversed(KIND_RULES):
        if where == "inspection":
            fits = low.contains("inspection") & low.rlike(pattern)
        else:
            fits = {"section": title, "text": raw, "lower": low}[where].rlike(pattern)
        out = F.when(fits, kind).otherwise(out)
    return out


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_.-]+", "_")


def source_id(key: Column, name: Column) -> Column:
    """A name with eight digits of the MD5 of a key that the caller chooses, so that ids do not hang on paths."""
    return F.concat(safe_name(name), F.lit("-"), F.substring(F.md5(key), 1, 8))


def chunk_id(source: Column, index: Column) -> Column:
    return F.format_string("manuals::%s::chunk_%06d", source, index)


def snippet(c: Column, size: int = 240) -> Column:
    flat = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def unique(items: Column, most: int | None = None) -> Column:
    """Stripped non-blank items, first occurrences in order, at most so many."""
    kept = F.array_distinct(F.filter(F.transform(items, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    return kept if most is None else F.slice(kept, 1, most)


def simple_terms(text: Column, most: int = 12) -> Column:
    """Phrases of two neighbouring words, those with a priority phrase first, then single words; without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]+(?:-[a-z]+)?|\d+(?:\.\d+)?|°"), 0)
    words = F.filter(found, lambda t: ~t.isin(list(STOP_WORDS)) & (F.length(t) > 2))
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    before = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    alpha = lambda t: t.rlike("^[a-z]+$")
    pairs = F.filter(F.zip_with(before, after, lambda a, b: F.when(alpha(a) & alpha(b), F.concat(a, F.lit(" "), b))), lambda p: p.isNotNull())
    first = F.filter(pairs, lambda p: any_of([p.contains(k) for k in PRIORITY_PHRASES]))
    return F.slice(F.array_distinct(F.concat(first, pairs, words)), 1, most)


def at_least(items: Column, least: int, text: Column) -> Column:
    """items, with the simple terms of a text added if there are fewer than least."""
    return F.when(F.size(items) < least, F.array_distinct(F.concat(items, simple_terms(text, 20)))).otherwise(items)


def json_in(c: Column) -> Column:
    """The text from the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank, stripped."""
    return F.coalesce(*(F.nullif(strip(t), F.lit("")) for t in texts))


def allowed(section: Column, text: Column, must: list[str], exclude: list[str]) -> Column:
    """No excluded term occurs in section and text, and all demanded ones do; letters' case does not count."""
    body = F.lower(F.concat(F.coalesce(section, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    tests = [~body.contains(t.lower()) for t in exclude if t] + [body.contains(t.lower()) for t in must if t]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
