"""From manuals to chunks: pages, cleaning, blocks, merging, chunks. One row per page, block or chunk throughout.

Order is always a column. Windows are partitioned by manual and so are as large as one manual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathom.functions import text as T
from fathom.operators.ordered import carried
from fathom.staging import staged

PAGE, OUTLINE, SOURCE = r"^=== PAGE (\d+) ===$", r"^=== OUTLINE_SECTION: (.*?) ===$", "SOURCE_PDF:"


def parse_pages(manuals: DataFrame) -> DataFrame:
    """source, page_index, text, outline_section, source_pdf from exported manuals (source, text).

    Marker lines start pages; an outline marker names its page's section; a source line is in force until the next one.
    Text before the first page marker belongs to no page. A manual without markers is one page with a null index.
    """
    raw = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    paged = manuals.where(raw.contains("=== PAGE "))
    lines = paged.select("source", F.posexplode(F.split(raw, "\n")).alias("pos", "line")).withColumn("bare", T.strip(F.col("line")))
    w = Window.partitionBy("source").orderBy("pos")
    is_source = F.col("line").startswith(SOURCE)
    is_page = ~is_source & F.col("bare").rlike(PAGE)
    is_outline = ~is_source & ~is_page & F.col("bare").rlike(OUTLINE)
    marked = lines.select(
        "source",
        "pos",
        "line",
        F.sum(F.when(is_page, 1).otherwise(0)).over(w).alias("page"),
        F.when(is_page, F.regexp_extract("bare", PAGE, 1).cast("int")).alias("page_index"),
        F.when(is_outline, T.strip(F.regexp_extract("bare", OUTLINE, 1))).alias("outline"),
        F.last(F.when(is_source, T.strip(F.expr(f"substring(line, {len(SOURCE) + 1})"))), ignorenulls=True).over(w).alias("pdf"),
        (is_source | is_page | is_outline).alias("marker"),
    )
    body = F.filter(F.array_sort(F.collect_list(F.when(~F.col("marker"), F.struct("pos", "line")))), lambda x: x.isNotNull())
    pages = marked.where("page > 0").groupBy("source", "page").agg(
        F.max("page_index").alias("page_index"),
        body.alias("body"),
        F.max(F.when(F.col("outline").isNotNull(), F.struct("pos", "outline")))["outline"].alias("outline_section"),
        F.max(F.when(F.col("pdf").isNotNull(), F.struct("pos", "pdf")))["pdf"].alias("source_pdf"),
    )
    text = T.normalize(F.array_join(F.col("body.line"), "\n"))
    pages = pages.select("source", "page_index", text.alias("text"), "outline_section", "source_pdf")
    none = F.lit(None).cast("string")
    single = manuals.where(~raw.contains("=== PAGE ")).select("source", F.lit(None).cast("int").alias("page_index"), T.normalize(raw).alias("text"), none.alias("outline_section"), none.alias("source_pdf"))
    return pages.unionByName(single)


def skip_leading(pages: DataFrame, manuals: list[str], most: int) -> DataFrame:
    """Of the named manuals (* names all) only pages after the first most; a page without an index stays."""
    base = F.regexp_replace("source", r"(?i)\.(pdf|txt)$", "")
    named = F.lit("*" in manuals) | F.col("source").isin(manuals) | base.isin(manuals) | F.concat(base, F.lit(".pdf")).isin(manuals) | F.concat(base, F.lit(".txt")).isin(manuals)
    return pages.where(~named | F.col("page_index").isNull() | (F.col("page_index") > most))


def filter_pages(pages: DataFrame, least_tokens: int = 20) -> DataFrame:
    """Pages with so many tokens; 0 keeps all."""
    return pages if least_tokens <= 0 else pages.where(T.token_count(F.col("text")) >= least_tokens)


def common_lines(pages: DataFrame, manual: str = "source", share: float = 0.8, least_pages: int = 5) -> DataFrame:
    """manual, line, pages: lines of at most 80 characters on at least share (and two) of a manual's pages, of which
    there must be least_pages. Each line counts once a page, before the shuffle."""
    count = pages.groupBy(manual).agg(F.count("*").alias("total")).where(F.col("total") >= least_pages)
    lines = pages.select(manual, F.explode(F.array_distinct(F.transform(F.split("text", "\n"), T.strip))).alias("line"))
    lines = lines.where((F.col("line") != "") & (F.length("line") <= 80)).groupBy(manual, "line").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(2), F.ceil(F.col("total") * share))
    return lines.join(count, manual).where(F.col("pages") >= least).drop("total")


def clean_pages(pages: DataFrame, manual: str = "source") -> DataFrame:
    """Noise lines go, then lines that most pages of a manual share; pages that get empty go. Other columns stay.

    Pages without noise are staged: their lines are counted, and then they are joined with the counts."""
    cleaned = staged(pages.withColumn("text", T.normalize(T.without_noise(F.col("text")))).where("text <> ''"), "cleaned")
    shared = common_lines(cleaned, manual).groupBy(manual).agg(F.collect_set("line").alias("_common"))
    joined = cleaned.join(shared, manual, "left")
    rest = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_common"), T.strip(x)))
    text = F.when(F.col("_common").isNull(), F.col("text")).otherwise(T.normalize(F.array_join(rest, "\n")))
    return joined.withColumn("text", text).where("text <> ''").select(pages.columns)


def split_blocks(pages: DataFrame, manual: str = "source", page: str = "page_index", true_end: bool = False) -> DataFrame:
    """manual, block_no, page_index, page_end, heading, text: a block starts at each heading line and may span pages.

    page_end repeats the first page by default; true_end gives the last page instead.
    """
    lines = pages.select(manual, F.col(page).alias("page"), F.posexplode(F.transform(F.split("text", "\n"), T.strip)).alias("pos", "line")).where("line <> ''")
    lines = lines.withColumn("head", T.is_heading(F.col("line")))
    w = Window.partitionBy(manual).orderBy("page", "pos")
    numbered = lines.withColumn("island", F.sum(F.col("head").cast("int")).over(w))
    at = F.struct("page", "pos", "line", "head")
    blocks = numbered.groupBy(manual, "island").agg(F.min(at).alias("first"), F.max("page").alias("last"), F.array_sort(F.collect_list(F.struct("page", "pos", "line"))).alias("lines"))
    number = F.row_number().over(Window.partitionBy(manual).orderBy("island")) - 1
    return blocks.select(
        manual,
        number.alias("block_no"),
        F.col("first.page").alias("page_index"),
        (F.col("last") if true_end else F.col("first.page")).alias("page_end"),
        F.when(F.col("first.head"), F.col("first.line")).alias("heading"),
        F.array_join(F.col("lines.line"), " ").alias("text"),
    )


def with_section(pages: DataFrame, sections: DataFrame, manual: str = "source") -> DataFrame:
    """manual, page_index, text, at: each page with the last section (a struct of sections' first, page_end, heading) that begins
    at or before it; an as-of merge by one pass over both in order, so no task holds a manual and no two rows are compared."""
    at = F.struct(F.col("first"), F.col("page_end"), F.col("heading"))
    none = lambda kind: F.lit(None).cast(kind)
    section, page = sections.select(at.alias("at")).schema["at"].dataType, pages.schema["page_index"].dataType
    asked = pages.where("page_index is not null").select(manual, "page_index", F.lit(1).alias("_kind"), "text", none(section).alias("_at_section"))
    answers = sections.select(manual, F.col("first").cast(page).alias("page_index"), F.lit(0).alias("_kind"), none("string").alias("text"), at.alias("_at_section"))
    merged = carried(answers.unionByName(asked), manual, ["page_index", "_kind"], "_at_section", "at")
    return merged.where("_kind = 1").select(manual, "page_index", "text", "at")


def outline_blocks(pages: DataFrame, outline: DataFrame, manual: str = "source") -> DataFrame:
    """Sections from outline entries (manual, page_index, title, entry_no): the last entry of a page wins, a section ends
    before the next one or with the manual; sections without text and pages before the first entry are lost."""
    last = outline.groupBy(manual, "page_index").agg(F.max_by("title", "entry_no").alias("heading"))
    end = pages.groupBy(manual).agg(F.max("page_index").alias("max_page"))
    w = Window.partitionBy(manual).orderBy("page_index")
    ranges = last.join(end, manual).select(manual, F.col("page_index").alias("first"), F.coalesce(F.lead("page_index").over(w) - 1, "max_page").alias("page_end"), "heading")
    found = with_section(pages.where("text <> ''"), ranges, manual).where("at.first > 0 and at.page_end > 0 and page_index between at.first and at.page_end")
    grouped = found.groupBy(manual, F.col("at.first").alias("first"), F.col("at.page_end").alias("page_end"), F.col("at.heading").alias("heading")).agg(
        F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("texts")
    )
    number = F.row_number().over(Window.partitionBy(manual).orderBy("first")) - 1
    return grouped.select(manual, number.alias("block_no"), F.col("first").alias("page_index"), "page_end", "heading", F.array_join(F.col("texts.text"), " ").alias("text"))


def page_outline(pages: DataFrame, manual: str = "source") -> DataFrame:
    """Outline entries from the sections that pages name themselves."""
    return pages.where("outline_section is not null").select(manual, "page_index", F.col("outline_section").alias("title"), F.lit(0).alias("entry_no"))


def merge_groups(sizes: DataFrame, manual: str = "source", least_tokens: int = 60, least_alpha: float = 0.6) -> DataFrame:
    """manual, block_no, group: the number of the group that each block of sizes (manual, block_no, n, letters, alnum) goes to; a
    group ends with the block that gives it enough tokens and letters."""
    schema = StructType([sizes.schema[manual], sizes.schema["block_no"], *StructType.fromDDL("group int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group, n, letters, alnum = object(), 0, 0, 0, 0
        for b in batches:
            groups = []
            for name, *size in zip(*(b.column(c).to_pylist() for c in (manual, "n", "letters", "alnum"))):
                if name != own:
                    own, group, n, letters, alnum = name, 0, 0, 0, 0
                n, letters, alnum = n + size[0], letters + size[1], alnum + size[2]
                groups.append(group)
                if n >= least_tokens and (letters / alnum if alnum else 0.0) >= least_alpha:
                    group, n, letters, alnum = group + 1, 0, 0, 0
            yield pa.RecordBatch.from_arrays([b.column(manual), b.column("block_no"), pa.array(groups, pa.int32())], names=schema.names)

    in_order = sizes.repartition(manual).sortWithinPartitions(manual, "block_no")
    return in_order.select(manual, "block_no", "n", "letters", "alnum").mapInArrow(run, schema)


def merge_blocks(blocks: DataFrame, manual: str = "source", least_tokens: int = 60, least_alpha: float = 0.6) -> DataFrame:
    """Blocks are joined to the next until they have enough tokens and letters; what is left at the end stays as it is.

    Tokens and letters add up under joining with spaces, so the fold carries three counts from block to block: it streams
    over a manual's sizes in order, in memory that does not grow with the manual. Texts are joined after it.
    """
    blocks = staged(blocks, "blocks")
    count = lambda letters: F.regexp_count("text", F.lit(letters)).alias
    sizes = blocks.select(manual, "block_no", T.token_count(F.col("text")).alias("n"), count("[A-Za-z]")("letters"), count("[A-Za-z0-9]")("alnum"))
    placed = blocks.join(merge_groups(sizes, manual, least_tokens, least_alpha), [manual, "block_no"])
    at = lambda c: F.struct("block_no", c)
    merged = placed.groupBy(manual, "group").agg(
        F.min(at("page_index"))["page_index"].alias("page_index"),
        F.max(F.when(F.col("page_end").isNotNull(), at("page_end")))["page_end"].alias("page_end"),
        F.min(F.when(F.coalesce("heading", F.lit("")) != "", at("heading")))["heading"].alias("heading"),
        F.array_sort(F.collect_list(at("text"))).alias("texts"),
    )
    return merged.select(manual, F.col("group").alias("block_no"), "page_index", "page_end", "heading", T.strip(F.array_join(F.col("texts.text"), " ")).alias("text"))


def chunk_blocks(blocks: DataFrame, manual: str = "source", size: int = 450, overlap: int = 70, sections: bool = False, most: int = 800, least: int = 120) -> DataFrame:
    """Chunks of a manual's blocks: sliding windows of size tokens, and the whole section where sections are wanted and it
    has least to most tokens (instead of windows, if it fits into one). chunk_index counts through the manual."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    rows = blocks.withColumn("tokens", T.tokens(F.col("text"))).withColumn("n", F.size("tokens")).where("n > 0")
    starts = F.sequence(F.lit(0), F.when(F.col("n") <= size, 0).otherwise(F.ceil((F.col("n") - size) / step).cast("int") * step), F.lit(step))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(F.col("tokens"), s + 1, F.lit(size)).alias("part")))
    whole = F.array(F.struct(F.lit(-1).alias("start"), F.col("tokens").alias("part")))
    if sections:
        fits = F.col("n").between(least, most)
        pieces = F.when(fits & (F.col("n") <= size), whole).when(fits, F.concat(whole, pieces)).otherwise(pieces)
    chunks = rows.select(manual, "block_no", F.col("page_index").alias("page"), "page_end", F.col("heading").alias("section"), F.explode(pieces).alias("p"))
    text = F.array_join(F.col("p.part"), " ")
    index = F.row_number().over(Window.partitionBy(manual).orderBy("block_no", "p.start")) - 1
    made = chunks.select(manual, "page", "page_end", "section", index.alias("chunk_index"), text.alias("text"))
    return made.select(
        T.chunk_id(F.col(manual).cast("string"), F.col("chunk_index")).alias("chunk_id"), manual, "page", "page_end", "section",
        T.chunk_kind(F.col("section"), F.col("text")).alias("chunk_kind"), "text", "chunk_index",
    )


def build_chunks(manuals: DataFrame, least_page_tokens: int = 20, skip: tuple[list[str], int] = ([], 0), use_outline: bool = True, keep: Callable[[DataFrame, str], DataFrame] = staged, **chunking) -> DataFrame:
    """Exported manuals (source, text) to chunks: parse, clean (paged manuals are cleaned on loading and again), skip,
    outline or headings, merge, chunk.

    Each step's pages are read several times, so keep stages them (table and name).
    """
    pages = keep(parse_pages(manuals), "pages")
    paged = clean_pages(pages.where("page_index is not null")).unionByName(pages.where("page_index is null"))
    pages = keep(clean_pages(skip_leading(paged, *skip)), "clean_pages")
    entries = page_outline(pages).where(F.lit(use_outline))
    body = filter_pages(pages, least_page_tokens)
    outlined = outline_blocks(body, entries)
    plain = split_blocks(body.join(outlined.select("source").distinct(), "source", "left_anti"))
    return chunk_blocks(merge_blocks(outlined.unionByName(plain)), **chunking)
