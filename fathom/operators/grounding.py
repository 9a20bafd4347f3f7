"""Payloads for steps that a language model takes, and what can be checked in its answers without one.

No model is called: a payload is a column of JSON for whoever calls one, and an answer is a column of text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T

# The codes that a diagnosis may give.
RISK_CODES = ("high_risk", "medium_risk", "low_risk", "no_risk", "not_classified")


@dataclass(frozen=True)
class Field:
    """What a value must be: text, number, whole, list or object. items is the kind of a list's items, fields are those of an
    object, which may have no others; choices, if given, are the only texts allowed."""

    kind: str
    fields: dict[str, Field] | None = None
    items: Field | None = None
    choices: tuple[str, ...] = ()
    optional: bool = False


# The fields of query packs, diagnoses and reports.
TEXT, NUMBER = Field("text"), Field("number")
TEXTS = Field("list", items=TEXT)
METRICS = Field("list", items=Field("object", {"name": TEXT, "value": NUMBER}))
FACTS = Field("object", {"codes": TEXTS, "scada_terms": TEXTS, "image_terms": TEXTS, "notes_terms": TEXTS, "key_metrics": METRICS})
QUERY_PACK = Field("object", {"query": TEXT, "must_terms": TEXTS, "should_terms": TEXTS, "exclude_terms": TEXTS, "extracted_facts": FACTS})
DIAGNOSIS = Field("object", {"diagnosis": TEXT, "risk_code": Field("text", choices=RISK_CODES, optional=True)})
REPORT = Field("object", {"summary": TEXT, "recommended_action": TEXT, "evidence": Field("list", items=Field("object", {"chunk_id": TEXT, "quote_or_reason": TEXT}))})
_KINDS = {"text": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "whole": ("BIGINT",), "list": ("ARRAY",), "object": ("OBJECT",)}


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: conditions and lambdas work out anew what they name."""
    return F.transform(F.array(value), then)[0]


def _fields(own: Column, fields: dict[str, Field], at: Column) -> Column:
    """Errors of an object, which is a map of variants: keys that are not expected, then what its fields have."""
    place = lambda name: F.concat(at, F.lit("." + name))
    extra = F.array_sort(F.array_except(F.map_keys(own), F.lit(list(fields))))
    parts = [F.transform(extra, lambda k: F.concat(at, F.lit("."), k, F.lit(": not expected")))]
    for name, field in fields.items():
        missing = F.array().cast("array<string>") if field.optional else F.array(F.concat(place(name), F.lit(": missing")))
        parts.append(F.when(F.map_contains_key(own, name), _found(own[name], field, place(name))).otherwise(missing))
    return F.concat(*parts)


def _found(value: Column, field: Field, at: Column) -> Column:
    """Errors of a variant value that is there, each with its place."""
    wrong = F.array(F.concat(at, F.lit(f": not a {field.kind}")))
    if field.kind == "object" and field.fields is not None and not field.choices:
        return _once(F.try_variant_get(value, "$", "map<string, variant>"), lambda own: F.when(own.isNull(), wrong).otherwise(_fields(own, field.fields, at)))
    if field.kind == "list" and field.items and not field.choices:
        each = lambda x, k: _found(x, field.items, F.concat(at, F.lit("["), k.cast("string"), F.lit("]")))
        return _once(F.try_variant_get(value, "$", "array<variant>"), lambda own: F.when(own.isNull(), wrong).otherwise(F.flatten(F.transform(own, each))))
    none = F.array().cast("array<string>")
    fits = lambda said: F.coalesce(T.any_of([said.startswith(k) for k in _KINDS[field.kind]]), F.lit(False))
    errors = none
    if field.choices:
        errors = F.when(~F.coalesce(F.try_variant_get(value, "$", "string").isin(*field.choices), F.lit(False)), F.array(F.concat(at, F.lit(": not allowed"))))
    return _once(F.schema_of_variant(value), lambda said: F.when(~fits(said), wrong).otherwise(F.coalesce(errors, none)))


def schema_errors(answer: Column, schema: Field) -> Column:
    """What is wrong with an answer in JSON against a closed schema, at any depth, as an array of place and fault; empty if
    nothing is. A text that is no JSON, or null, has the one fault that it is no object."""
    wrong = F.array(F.lit(f"$: not a {schema.kind}"))
    return _once(F.try_parse_json(answer), lambda value: F.when(value.isNull(), wrong).otherwise(_found(value, schema, F.lit("$"))))


def risk_of(answer: Column) -> Column:
    """diagnosis and risk_code of an answer: blanks and texts that are no JSON give (no diagnosis), unknown codes not_classified."""
    value = F.try_parse_json(answer)
    told = T.first_filled(F.try_variant_get(value, "$.diagnosis", "string"))
    code = F.try_variant_get(value, "$.risk_code", "string")
    return F.struct(F.coalesce(told, F.lit("(no diagnosis)")).alias("diagnosis"), F.when(code.isin(*RISK_CODES), code).otherwise(F.lit("not_classified")).alias("risk_code"))


def report_payloads(queries: DataFrame, hits: DataFrame, most: int = 10, size: int = 1800, query: str = "query_id", text: str = "query_text") -> DataFrame:
    """query, payload: the query's text, its first hits (query, rank, chunk_id, source, page, page_end, section, chunk_kind, text) with
    their texts cut to size, and the form of the answer that is asked for. A query without hits has an empty list."""
    chunk = F.struct("rank", F.struct("chunk_id", "source", "page", "page_end", "section", "chunk_kind", F.substring("text", 1, size).alias("text")).alias("c"))
    per = hits.where(F.col("rank") <= most).groupBy(query).agg(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["c"]).alias("chunks"))
    asked = lambda *names: [F.lit("string").alias(n) for n in names]
    form = F.struct(*asked("summary", "recommended_action"), F.array(F.struct(*asked("chunk_id", "quote_or_reason"))).alias("evidence"))
    joined = queries.select(query, text).join(per, query, "left")
    none = F.array().cast(per.schema["chunks"].dataType)
    return joined.select(query, F.to_json(F.struct(F.col(text).alias("query"), F.coalesce("chunks", none).alias("chunks"), form.alias("output_schema"))).alias("payload"))


def advice_payloads(contexts: DataFrame, hits: DataFrame, most: int = 10, size: int = 1800, query: str = "query_id", context: str = "context") -> DataFrame:
    """query, payload: a context (a struct) and its first hits as numbered blocks of text, whose form is fixed."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    block = F.concat(
        F.lit("CHUNK "), F.col("rank").cast("string"), F.lit(": ["), unknown("source"), F.lit(" p"), unknown("page"), F.lit("-"), unknown("page_end"), F.lit("] "), F.coalesce("section", F.lit("")), F.lit("\n"),
        F.substring(F.coalesce("text", F.lit("")), 1, size), F.lit("\n"),
    )
    per = hits.where(F.col("rank") <= most).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"))
    told = F.coalesce(F.col("blocks.b"), F.array().cast("array<string>"))
    return contexts.select(query, context).join(per, query, "left").select(query, F.to_json(F.struct(F.col(context).alias("context"), told.alias("retrieved_chunks"))).alias("payload"))


def cited(answer: Column) -> Column:
    """The chunk ids in square brackets, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[([^\[\]\s]+::[^\[\]\s]+)\]"), 1))


def citations(answers: DataFrame, hits: DataFrame, query: str = "query_id", answer: str = "answer") -> DataFrame:
    """query, known, unknown, unused of each answer: chunk ids that it cites and was given, cites and was not given, and was given and
    does not cite; grounded says that it cites something and nothing unknown. An answer without hits knows none."""
    given = hits.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("given"))
    rows = answers.select(query, cited(F.col(answer)).alias("cited")).join(given, query, "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>")))
    known, unknown = F.array_intersect("cited", "given"), F.array_except("cited", "given")
    return rows.select(query, known.alias("known"), unknown.alias("unknown"), F.array_except("given", "cited").alias("unused"), ((F.size(known) > 0) & (F.size(unknown) == 0)).alias("grounded"))


def resolve_cases(requests: DataFrame, cards: DataFrame, samples: DataFrame) -> DataFrame:
    """request_id, origin, case (JSON): of each request (request_id, window_id, inline) the case that came with it, else the card of its
    window (window_id, card), else the first sample (nth, id, case) of that id; origin names which, or none."""
    first = samples.groupBy(F.col("id").alias("window_id")).agg(F.min_by("case", "nth").alias("sample"))
    card = cards.groupBy("window_id").agg(F.min("card").alias("card"))
    rows = requests.join(card, "window_id", "left").join(first, "window_id", "left")
    inline = F.nullif(T.strip(F.col("inline")), F.lit(""))
    origin = F.when(inline.isNotNull(), "inline").when(F.col("card").isNotNull(), "card").when(F.col("sample").isNotNull(), "sample").otherwise("none")
    return rows.select("request_id", origin.alias("origin"), F.coalesce(inline, "card", "sample").alias("case"))


def case_summary(case: Column) -> Column:
    """The first filled text of a case in JSON: its summary, its inner case's, the event's description, label as shown, label."""
    value = F.try_parse_json(case)
    return F.coalesce(T.first_filled(*(F.try_variant_get(value, f"$.{p}", "string") for p in ("summary", "case.summary", "event_description", "event_label_display", "event_label"))), F.lit(""))
