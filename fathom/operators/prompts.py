"""Prompts for descriptions of images, and what is checked in the answers. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def description_prompts(queries: DataFrame, examples: DataFrame, head: str, rules: list[str], categories: list[str], tail: str) -> DataFrame:
    """image, prompt and attachments (array of label, path) of each query (image, path, tiles as an array of paths).

    examples (nth, path, findings as an array of category_name and image_description, gold_text) are few, as chosen
    for one prompt, and the same for all queries; head, rules, categories and tail are the caller's texts.
    """
    finding = lambda f: F.concat(F.lit("- "), f["category_name"], F.coalesce(F.concat(F.lit(": "), F.nullif(f["image_description"], F.lit(""))), F.lit("")))
    name = F.concat(F.lit("example_"), F.col("nth").cast("string"))
    answer = F.concat(F.lit("Expected output:\n"), F.to_json(F.struct(F.col("gold_text").alias("description"))))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Example "), F.col("nth").cast("string"), F.lit(":")), F.concat(F.lit("- Image: <"), name, F.lit(">")),
        F.when(F.size("findings") > 0, F.concat(F.lit("Findings:\n"), F.array_join(F.transform("findings", finding), "\n"))), F.when(F.col("gold_text") != "", answer),
    )
    shown = examples.select("nth", lines.alias("lines"), F.struct(name.alias("label"), "path").alias("file"))
    one = shown.agg(F.array_sort(F.collect_list(F.struct("nth", "lines", "file"))).alias("_shown"))  # one row
    fixed = "\n".join([head, "", "Categories:", *(f"- {k}: {c}" for k, c in enumerate(categories)), "", "Rules:", *(f"- {r}" for r in rules), ""])
    tiles = F.coalesce("tiles", F.array().cast("array<string>"))
    files = F.concat(F.array(F.struct(F.lit("query_full").alias("label"), F.col("path"))), F.transform(tiles, lambda p, k: F.struct(F.concat(F.lit("query_tile_"), (k + 1).cast("string")).alias("label"), p.alias("path"))))
    asked = F.array_join(F.transform(files, lambda f: F.concat(F.lit("- <"), f["label"], F.lit(">"))), "\n")
    prompt = F.concat_ws("\n", F.lit(fixed), F.array_join(F.col("_shown.lines"), "\n\n"), F.lit(""), F.lit("Query:"), asked, F.lit(""), F.lit(tail))
    return queries.join(F.broadcast(one)).select("image", prompt.alias("prompt"), F.concat(F.col("_shown.file"), files).alias("attachments"))


def answer_errors(answer: Column) -> Column:
    """What is wrong with an answer in JSON, as an array; empty if it is an object whose description is a text."""
    kind = F.schema_of_variant(F.try_parse_json(answer))
    told = F.try_variant_get(F.try_parse_json(answer), "$.description", "string")
    of_field = F.schema_of_variant(F.try_variant_get(F.try_parse_json(answer), "$.description", "variant"))
    return (
        F.when(kind.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("answer: not an object")))
        .when(of_field.isNull(), F.array(F.lit("description: missing")))
        .when((of_field != "STRING") | told.isNull(), F.array(F.lit("description: not a text")))
        .otherwise(F.array().cast("array<string>"))
    )
