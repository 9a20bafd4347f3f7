"""Secret scans over a trigram inverted index, in Spark's own functions only.

From each rule's regular expression a Boolean query over case-folded trigrams is derived: an OR of clauses, each an AND
of trigrams that every match of that clause must contain. The index holds the postings (trigram, doc_id) of the trigrams
that some query asks for. Postings are intersected by counting a clause's trigrams for each document, and only the
candidates of a rule are verified by its expression. A rule without mandatory trigrams scans every text.

Edge cases: a null text counts as empty and has no spans; matches of a rule are leftmost and do not overlap; rows that
repeat a doc_id share candidates, which are a superset, and are verified one by one; an empty table gives an empty
result; texts of any length are scanned whole by Spark's own functions; other columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, same, staged, text_or_empty

#: Strings that a part of an expression may expand to before it counts as anything.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """pattern is read by Spark and, for its trigrams, by Python, so it keeps to what both read alike.

    group, if given, must have at least least characters, else the match is dropped. base rules make the base spans.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    # Fixed patterns of the contract; the minimum lengths of access and hex are written into their repeats.
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    # Published formats of other credentials.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abpr]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _strings(tree) -> list[set[str] | None]:
    """The parts of a parsed expression in order: the case-folded strings that a part can be, or None for anything."""
    parts: list[set[str] | None] = []
    for op, value in tree:
        if op is sre.LITERAL:
            parts.append({chr(value).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            parts.append({chr(v).lower() for _, v in value})
        elif op is sre.SUBPATTERN:
            parts += _strings(value[3])
        elif op is sre.BRANCH:
            options = [_join(_strings(x)) for x in value[1]]
            parts.append(set().union(*(o[0] for o in options)) if all(len(o) == 1 and o[0] for o in options) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1 and (own := _join(_strings(value[2]))) and len(own) == 1 and own[0]:
            parts.append(own[0] | {""} if value[0] == 0 else own[0])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0 and (own := _strings(value[2])):
            parts += [*own * min(value[0], 3), None]
        else:
            parts.append(None)
    return parts


def _join(parts: list[set[str] | None]) -> list[set[str] | None]:
    """Neighbouring sets are multiplied out while they stay small."""
    out: list[set[str] | None] = []
    for p in parts:
        if p and out and out[-1] and len(p) * len(out[-1]) <= MAX_STRINGS:
            out[-1] = {a + b for a in out[-1] for b in p}
        else:
            out.append(p)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which a match contains at least one whole; empty if there are no mandatory trigrams."""
    best: list[frozenset[str]] = []
    for strings in _join(_strings(parser.parse(pattern))):
        if strings and all(len(s) >= 3 and s.isascii() for s in strings):
            clauses = sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)
            if not best or min(map(len, clauses)) > min(map(len, best)):
                best = [c for c in clauses if not any(o < c for o in clauses)]
    return best


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id: which of the trigrams each case-folded text contains."""
    # The text is folded in a step of its own: inside the generator it would be folded anew for each trigram.
    folded = docs.select("doc_id", F.lower("text").alias("folded"))
    found = F.array_compact(F.array(*(F.when(F.col("folded").contains(t), F.lit(t)) for t in trigrams)))
    return folded.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules (a bit for each rule that has mandatory trigrams and a clause whose postings all hold the row)."""
    queries = [(k, n, sorted(c)) for k, r in enumerate(rules) for n, c in enumerate(trigram_query(r.pattern))]
    if not queries:
        return docs.select("doc_id", F.lit(0).alias("rules")).limit(0)
    # A row for each trigram of a clause: its bit, and all bits of the clause. Rules are a parameter, so this is small.
    clauses = [(k, n, t, 1 << i, (1 << len(c)) - 1) for k, n, c in queries for i, t in enumerate(c)]
    clause = docs.sparkSession.createDataFrame(clauses, "rule int, clause int, trigram string, bit long, all long")
    found = postings(docs, sorted({x[2] for x in clauses})).join(F.broadcast(clause), "trigram")
    whole = found.groupBy("doc_id", "rule", "clause", "all").agg(F.bit_or("bit").alias("met")).where(F.col("met") == F.col("all"))
    return whole.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches: matches and what lies between them give the offsets."""
    whole = F.lit(f"(?:{rule.pattern})") if rule.group == 0 else F.lit(rule.pattern)
    matched = F.regexp_extract_all(text, whole, 0)
    held = F.regexp_extract_all(text, whole, rule.group) if rule.group else matched
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matched))
    parts = F.arrays_zip(gaps.alias("gap"), matched.alias("match"), held.alias("held"))
    empty = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + F.length(x["gap"])
        span = F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), (F.length(x["held"]) >= rule.least).alias("ok"))
        return F.concat(acc, F.array(span))

    found = F.filter(F.aggregate(parts, empty, step), lambda s: s["ok"])
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, and for each rule a column span_<kind> with its spans; one row per document."""
    own = docs.select("doc_id", text_or_empty(docs).alias("text"))
    prepare(docs.sparkSession)
    found = staged(candidates(own, rules), "candidates").select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
    # A rule that must scan everything does so before the join, and only texts with a candidate rule go into it.
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    joined = own.join(found, same(own["doc_id"], found["_id"]), "left")
    columns = []
    for k, r in enumerate(rules):
        spans = _spans(F.col("text"), r)
        if trigram_query(r.pattern):
            spans = F.when(F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(1 << k) != 0, spans).otherwise(none)
        else:
            spans = F.when(F.col("text").rlike(r.pattern), spans).otherwise(none)
        columns.append(spans.alias(f"span_{r.kind}"))
    return joined.select("doc_id", *columns)


def listed(spans: list[Column], kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    order = F.create_map(*(F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)))
    keyed = F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and spans (of all rules)."""
    base = [r.kind for r in rules if r.base]
    names, all_ = [f"span_{k}" for k in base], [r.kind for r in rules]
    found = scan(docs, rules)
    return found.select(
        "doc_id",
        *(F.size(n).cast("long").alias(n.replace("span_", "n_")) for n in names),
        F.sha2(listed([F.col(n) for n in names], base), 256).alias("base_sha256"),
        listed([F.col(f"span_{k}") for k in all_], all_).alias("spans"),
    )
