"""Query packs: from an incident's codes, summary, image description and notes to a balanced retrieval query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T

# Quotas, synonyms and excluded terms.
CODE_QUOTA, SOURCE_QUOTA, SYNONYM_QUOTA, SHOULD_QUOTA, MUST_QUOTA = 10, 10, 8, 20, 3
SYNONYMS = (
    "underperformance", "power deficit", "power residual", "below expected power", "yaw misalignment", "yaw error", "yaw offset", "overheating", "elevated temperature",
)
EXCLUDE = ("change log", "abbreviations", "terms and definitions", "course", "timetable", "assessment", "training standard")
METRICS = ("wind_speed_mean", "wind_speed_max", "power_mean", "yaw_misalignment_mean", "temp_mean", "power_residual_mean")


def _part(label: str, items: Column, sep: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, sep)))


def assemble(codes: Column, scada: Column, image: Column, notes: Column, synonyms: Column) -> Column:
    """struct of query, must_terms, should_terms, exclude_terms; empty parts are left out."""
    codes, synonyms = T.unique(codes, CODE_QUOTA), T.unique(synonyms, SYNONYM_QUOTA)
    scada, image, notes = (T.unique(x, SOURCE_QUOTA) for x in (scada, image, notes))
    parts = [_part("CODES", codes, " | "), _part("SCADA", scada, " ; "), _part("VISUAL", image, " ; "), _part("NOTES", notes, " ; "), _part("SYNONYMS", synonyms, " ; ")]
    must = T.unique(F.filter(codes, lambda c: c.contains(";") & (F.length(c) <= 10)), MUST_QUOTA)
    return F.struct(
        F.concat_ws("  ||  ", *parts).alias("query"),
        must.alias("must_terms"),
        T.unique(F.concat(scada, image, notes, synonyms), SHOULD_QUOTA).alias("should_terms"),
        F.array(*map(F.lit, EXCLUDE)).alias("exclude_terms"),
    )


def key_metrics(values: dict[str, Column]) -> Column:
    """array of (name, value) of those metrics that have a number."""
    return F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))) for n, v in values.items())))


def fallback_pack(cases: DataFrame) -> DataFrame:
    """case_id, pack from cases (case_id, class_label, event_description, tags, summary, fault_images_description,
    mechanic_notes and the six metrics), without any language model. A description of "nan" is none."""
    event = F.when(F.col("event_description") != "nan", F.col("event_description"))
    codes = F.concat(F.array_compact(F.array(F.col("case_id"), F.col("class_label"), event)), F.coalesce("tags", F.array().cast("array<string>")))
    scada = T.simple_terms(F.col("summary"), 12)
    image, notes = T.simple_terms(F.col("fault_images_description"), 10), T.simple_terms(F.col("mechanic_notes"), 10)
    made = cases.select("case_id", codes.alias("codes"), scada.alias("scada"), image.alias("image"), notes.alias("notes"), key_metrics({m: F.col(m) for m in METRICS}).alias("metrics"))
    facts = F.struct(F.col("codes"), F.col("scada").alias("scada_terms"), F.col("image").alias("image_terms"), F.col("notes").alias("notes_terms"), F.col("metrics").alias("key_metrics"))
    pack = assemble(F.col("codes"), F.col("scada"), F.col("image"), F.col("notes"), F.array(*map(F.lit, SYNONYMS)))
    return made.select("case_id", F.struct(pack["query"].alias("query"), pack["must_terms"].alias("must_terms"), pack["should_terms"].alias("should_terms"), pack["exclude_terms"].alias("exclude_terms"), facts.alias("extracted_facts")).alias("pack"))
