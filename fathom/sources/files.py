"""Scans and sinks. Folders are read in one plan with the file's name as a column; there is no loop over files."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom import schemas
from fathom.functions import text as T
from fathom.operators import ingest
from fathom.operators.ordered import numbered
from fathom.operators.timeseries import number, whole
from fathom.sources import pdf
from fathom.staging import staged

log = logging.getLogger(__name__)
#: Names of skipped files that are logged, at most.
LOGGED = 100


def file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def time_of(c: Column) -> Column:
    """A time of the usual two forms, null if it is of neither."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in forms)).cast("timestamp_ntz")


def stem() -> Column:
    return F.regexp_replace(file_name(), r"\.[^.]*$", "")


def manuals(spark: SparkSession, folder: str) -> DataFrame:
    """source (the file's name), text of every .txt file, whole."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return raw.select(F.url_decode(file_name()).alias("source"), F.col("value").alias("text"))


def manual_listing(spark: SparkSession, folder: str) -> DataFrame:
    """nth, name, path, kind of the files of a folder, in the order of their names: pdf, txt, or unsupported for all others, which the
    scans skip. Contents are not read."""
    named = spark.read.format("binaryFile").load(folder).select(F.col("path"), F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"))
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return numbered(named.withColumn("kind", F.when(ending.isin("pdf", "txt"), ending).otherwise("unsupported")), ["name", "path"], "nth").select("nth", "name", "path", "kind")


def manual_pages(spark: SparkSession, folder: str) -> DataFrame:
    """source, page_index, text, outline_section of the PDF and text manuals of a folder; of a PDF the last bookmark of a page names
    its section. Files that are neither are named in the log, and so are PDF files that cannot be read; both are skipped."""
    found = manual_listing(spark, folder)
    for r in found.where("kind = 'unsupported'").select("name").limit(LOGGED).collect():
        log.warning("skipped %s: neither PDF nor text", r["name"])
    pdfs = pdf.pdf_files(spark, folder)
    read = staged(pdf.pages_of(pdfs), "pdf-pages")
    for r in read.where("error is not null").limit(LOGGED).collect():
        log.warning("skipped %s: %s", r["path"], r["error"])
    marks = pdf.outline_of(pdfs).where("page_index is not null").groupBy("path", "page_index").agg(F.max_by("title", "entry").alias("outline_section"))
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    pages = read.where("error is null").join(marks, ["path", "page_index"], "left").select(name.alias("source"), "page_index", T.normalize(F.col("text")).alias("text"), "outline_section")
    texts = ingest.parse_pages(manuals(spark, folder)).select("source", "page_index", "text", "outline_section")
    return pages.unionByName(texts)


def write_manuals(pages: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Pages (source, page_index, text, outline_section) as exported text, a folder for each source. Without overwrite nothing is
    written if the folder is there; with it the sources at hand are replaced and others stay."""
    title = F.when(F.col("outline_section").isNotNull(), F.concat(F.lit("=== OUTLINE_SECTION: "), "outline_section", F.lit(" ===\n"))).otherwise("")
    page = F.concat(F.lit("=== PAGE "), F.col("page_index").cast("string"), F.lit(" ===\n"), title, "text")
    rows = pages.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page_index", page.alias("page")))).alias("p"))
    out = rows.select("source", F.concat(F.lit("SOURCE_PDF: "), "source", F.lit("\n"), F.array_join(F.col("p.page"), "\n")).alias("value"))
    out.write.mode("overwrite" if overwrite else "ignore").option("partitionOverwriteMode", "dynamic").partitionBy("source").text(folder)


def sensor_rows(spark: SparkSession, folder: str, features: list[str], sep: str = ";") -> DataFrame:
    """dataset_id (the file's stem), the core columns and the features of every CSV file. What is no number is null.

    The columns of a file are taken by name: files may hold others and in any order.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("pathGlobFilter", "*.csv").csv(folder)
    c = F.col
    return raw.select(
        whole(stem()).alias("dataset_id"), whole(c("asset_id")).alias("asset_id"), whole(c("id")).alias("id"), time_of(c("time_stamp")).alias("ts"), "train_test",
        whole(c("status_type_id")).alias("status_type_id"), *(number(c(f)).alias(f) for f in features),
    )


def event_info(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """One row per event; ids are integers, missing texts are the literal nan."""
    raw = spark.read.option("header", True).option("sep", sep).schema(schemas.EVENT_INFO).csv(path)
    text = [F.coalesce(n, F.lit("nan")).alias(n) for n in ("asset", "event_label", "event_start", "event_end", "event_description")]
    return raw.select(whole(F.col("event_id")).alias("event_id"), *text, whole(F.col("event_start_id")).alias("first_id"), whole(F.col("event_end_id")).alias("last_id"))


def embedded_csv(payloads: DataFrame, columns: list[str]) -> DataFrame:
    """window_id, nth and the named columns (strings) of the CSV texts inside payloads (window_id, csv, csv_sep)."""
    lines = payloads.select("window_id", "csv_sep", F.split(F.regexp_replace("csv", "\r\n?", "\n"), "\n").alias("l"))
    rows = lines.select("window_id", "csv_sep", F.col("l")[0].alias("head"), F.posexplode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("nth", "line")).where("line <> ''")
    cut = lambda c: F.split(c, F.concat(F.lit("\\Q"), F.coalesce("csv_sep", F.lit(";")), F.lit("\\E")))
    cells = rows.select("window_id", "nth", F.map_from_arrays(cut(F.col("head")), cut(F.col("line"))).alias("m"))
    return cells.select("window_id", "nth", *(F.try_element_at("m", F.lit(c)).alias(c) for c in columns))


def json_lines(spark: SparkSession, path: str, schema: str = schemas.GOLD_LINE) -> DataFrame:
    """Blank lines are skipped, bad ones dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> DataFrame:
    """The records of JSON files that are a list of records, or an object that holds one under wrapper."""
    if wrapper:
        return spark.read.schema(f"{wrapper} array<struct<{_colons(schema)}>>").option("multiLine", True).json(path).select(F.inline(wrapper))
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def _colons(schema: str) -> str:
    """A struct's inside from a list of columns: name type to name: type, at the top level only."""
    out, depth = [], 0
    for part in schema.split(", "):
        out.append(part if depth else part.replace(" ", ": ", 1))
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """The cards of a folder; files that are no cards are dropped."""
    raw = spark.read.schema(schemas.CARD).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*_card.json").json(folder)
    return raw.where("window_id is not null")


def write_json(df: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists") -> None:
    """Rows as JSON lines, in a folder per value of partition if one is named."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_records(rows: DataFrame, folder: str, record: str, suffix: str = "", mode: str = "errorifexists") -> None:
    """One JSON text (column record) per window_id, in a folder of the window's name and suffix: payloads and cards."""
    out = rows.select(F.concat("window_id", F.lit(suffix)).alias("window"), F.col(record).alias("value"))
    out.write.mode(mode).partitionBy("window").text(folder)


def write_class_map(by_class: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object: the window_ids of each class_no's class_code, in order. Classes are few."""
    row = by_class.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class_code"), F.col("window_ids"))))).alias("m"))
    row.select(F.to_json("m").alias("value")).coalesce(1).write.mode(mode).text(path)


def write_confusion(cells: DataFrame, labels: list[str], path: str, stats: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """A confusion matrix as CSV: a row for each label as gold, a column for each as prediction. cells has gold, pred, n;
    stats (label, tp, fp, fn, tn), if given, adds these columns. labels are few, so the matrix is."""
    wide = cells.groupBy("gold").pivot("pred", labels).agg(F.sum("n"))
    order = cells.sparkSession.createDataFrame([(k, x) for k, x in enumerate(labels)], "nth int, gold string")
    rows = order.join(wide, "gold", "left")
    columns = [F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels]
    if stats is not None:
        rows = rows.join(stats.withColumnRenamed("label", "gold"), "gold", "left")
        columns += [F.coalesce(k, F.lit(0)).alias(k.upper()) for k in ("tp", "fp", "fn", "tn")]
    rows.orderBy("nth").select(F.col("gold").alias("gold\\pred"), *columns).coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_labels(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """filename and pred_labels as CSV; labels sorted, joined by a bar."""
    out = rows.select("filename", F.array_join(F.array_sort(F.array_distinct("pred_labels")), "|").alias("pred_labels"))
    out.write.mode(mode).option("header", True).csv(path)


def coco(spark: SparkSession, path: str, namespaced: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of COCO files.

    Of images with one base name (without case) the first by file and id counts; categories are those of the first file
    that has any. Annotations belong to images of their own file; namespaced=False joins on the bare image id instead,
    so that ids which files share run together.
    """
    raw = spark.read.schema(schemas.COCO).option("multiLine", True).json(path).withColumn("file", file_name())
    images = raw.select("file", F.inline("images")).withColumnRenamed("id", "image_id")
    base = F.lower(F.element_at(F.split("file_name", "/"), -1))
    first = F.row_number().over(Window.partitionBy(base).orderBy("file", "image_id")) == 1
    images = images.withColumn("_first", first).where("_first").drop("_first")
    boxes = raw.select("file", F.inline("annotations")).where(F.size("bbox") == 4)
    boxes = boxes.select("file", F.col("id").alias("ann_id"), "image_id", "category_id", *(F.col("bbox")[k].alias(n) for k, n in enumerate(("bx", "by", "bw", "bh"))), "area")
    boxes = boxes.join(images.select("file", "image_id"), ["file", "image_id"], "left_semi") if namespaced else boxes.join(images.select("image_id").distinct(), "image_id", "left_semi")
    with_any = raw.where(F.size("categories") > 0).agg(F.min_by("categories", "file").alias("c"))
    return images, boxes, with_any.select(F.inline("c"))


def file_paths(spark: SparkSession, folder: str) -> DataFrame:
    """path of every file below a folder; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path")


def listed_names(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
