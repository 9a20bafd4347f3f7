"""Queries over scans: tables are made into the files' form as strings and read back by the same expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import ingest
from fathom.plans import sql_text as S
from fathom.sources import files
from fathom.sources.tables import table


def embedded_csv(spark, sf_dir):
    """Line items of an order as CSV text inside one row."""
    li = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(";", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag"))
    body = F.array_join(F.col("l.line"), "\n")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("l"))
    payloads = rows.select(F.col("l_orderkey").cast("string").alias("window_id"), F.concat(F.lit("n;part;flag\n"), body, F.lit("\n")).alias("csv"), F.lit(";").alias("csv_sep"))
    return files.embedded_csv(payloads, ["n", "flag", "absent"]).select("window_id", "n", "flag", "absent")


def paged_text(spark, sf_dir):
    """Conversations as exported manuals; turns are pages and users' turns have an outline section."""
    c = table(spark, sf_dir, "conversations")
    section = F.when(F.col("role") == "user", F.lit("=== OUTLINE_SECTION: Question ===\n")).otherwise("")
    page = F.concat(F.lit("=== PAGE "), (F.col("turn") + 1).cast("string"), F.lit(" ===\n"), section, "text")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("page")))).alias("p"))
    manuals = rows.select(F.col("conv_id").cast("string").alias("source"), F.concat(F.lit("SOURCE_PDF: a.pdf\nlost\n"), F.array_join(F.col("p.page"), "\n")).alias("text"))
    return ingest.parse_pages(manuals).select("source", "page_index", "outline_section", "source_pdf", F.md5("text").alias("text_md5"))


def built_chunks(spark, sf_dir):
    """The whole way from exported manuals to chunks."""
    c = table(spark, sf_dir, "conversations")
    page = F.concat(F.lit("=== PAGE "), (F.col("turn") + 1).cast("string"), F.lit(" ===\n"), "text")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("page")))).alias("p"))
    manuals = rows.select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("source"), F.array_join(F.col("p.page"), "\n").alias("text"))
    return ingest.build_chunks(manuals, 5, size=40, overlap=10).select("chunk_id", "page", "chunk_kind", F.md5("text").alias("text_md5"))


def _clean_sql(pages: str, out: str) -> str:
    """Common tables from pages (source, page_index, text) to out, without noise and common lines."""
    return f"""
{out}_l AS (SELECT source, page_index, pos, {S.strip('raw')} AS line, raw FROM
  (SELECT source, page_index, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM {pages})),
{out}_k AS (SELECT * FROM {out}_l WHERE line <> '' AND NOT {S.is_noise('line')}),
{out}_t AS (SELECT source, count(DISTINCT page_index) AS total FROM {out}_k GROUP BY source),
{out}_c AS (SELECT source, line FROM {out}_k JOIN {out}_t USING (source) WHERE length(line) <= 80 GROUP BY source, line, total
  HAVING total >= 5 AND count(DISTINCT page_index) >= greatest(2, ceil(total * 0.8))),
{out} AS (SELECT source, page_index, {S.normalize('string_agg(raw, chr(10) ORDER BY pos)')} AS text FROM (SELECT * FROM {out}_k ANTI JOIN {out}_c USING (source, line)) GROUP BY ALL)"""


_CHUNKS_SQL = f"""
WITH RECURSIVE p AS (SELECT 'm' || conv_id AS source, (turn + 1)::INT AS page_index, {S.normalize('text')} AS text FROM conversations),
{_clean_sql('p', 'once')},
{_clean_sql('once', 'clean')},
l AS (SELECT source, page_index AS page, unnest(range(len(string_split(text, chr(10))))) AS pos, {S.strip('unnest(string_split(text, chr(10)))')} AS line FROM clean WHERE len({S.tokens('text')}) >= 5),
h AS (SELECT *, {S.is_heading('line')} AS head FROM l WHERE line <> ''),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY source ORDER BY page, pos ROWS UNBOUNDED PRECEDING) AS island FROM h),
b AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY island) - 1)::INT AS block_no, arg_min(page, (page, pos)) AS page,
  CASE WHEN arg_min(head, (page, pos)) THEN arg_min(line, (page, pos)) END AS heading, string_agg(line, ' ' ORDER BY page, pos) AS text FROM n GROUP BY source, island),
s AS (SELECT *, len({S.tokens('text')}) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum FROM b),
f AS (SELECT source, block_no, 0 AS grp, n, letters, alnum, n >= 60 AND coalesce(letters / nullif(alnum, 0), 0) >= 0.6 AS done FROM s WHERE block_no = 0
  UNION ALL SELECT source, block_no, grp, n, letters, alnum, n >= 60 AND coalesce(letters / nullif(alnum, 0), 0) >= 0.6
  FROM (SELECT s.source, s.block_no, f.grp + f.done::INT AS grp, s.n + CASE WHEN f.done THEN 0 ELSE f.n END AS n, s.letters + CASE WHEN f.done THEN 0 ELSE f.letters END AS letters,
    s.alnum + CASE WHEN f.done THEN 0 ELSE f.alnum END AS alnum FROM f JOIN s ON s.source = f.source AND s.block_no = f.block_no + 1)),
m AS (SELECT f.source, f.grp AS block_no, min(s.page) AS page, arg_min(s.heading, s.block_no) FILTER (s.heading IS NOT NULL) AS heading, {S.tokens("string_agg(s.text, ' ' ORDER BY s.block_no)")} AS t
  FROM f JOIN s USING (source, block_no) GROUP BY f.source, f.grp),
w AS (SELECT *, unnest(range(1 + CASE WHEN len(t) <= 40 THEN 0 ELSE ceil((len(t) - 40) / 30)::INT END)) AS i FROM m),
c AS (SELECT source, page, heading, array_to_string(t[i * 30 + 1 : i * 30 + 40], ' ') AS text, (row_number() OVER (PARTITION BY source ORDER BY block_no, i) - 1)::INT AS chunk_index FROM w)
SELECT printf('manuals::%s::chunk_%06d', source, chunk_index) AS chunk_id, page, {S.chunk_kind('heading', 'text')} AS chunk_kind, md5(text) AS text_md5 FROM c"""

QUERIES = {f.__name__: f for f in (embedded_csv, paged_text, built_chunks)}


ORACLES = {
    "built_chunks": _CHUNKS_SQL,
    "embedded_csv": "SELECT l_orderkey::VARCHAR AS window_id, l_linenumber::VARCHAR AS n, l_returnflag AS flag, NULL::VARCHAR AS absent FROM lineitem",
    "paged_text": f"""SELECT conv_id::VARCHAR AS source, (turn + 1)::INT AS page_index, CASE WHEN role = 'user' THEN 'Question' END AS outline_section, 'a.pdf' AS source_pdf, md5({S.normalize('text')}) AS text_md5 FROM conversations""",
}
