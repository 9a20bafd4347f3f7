"""Queries over text: expressions, pages, blocks and chunks, with documents in the part of manuals or pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import ingest
from fathom.plans import sql_text as S
from fathom.sources.tables import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source."""
    return _documents(spark, sf_dir).select("source", F.col("doc_id").cast("int").alias("page_index"), T.normalize(F.col("text")).alias("text"))


def _own_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manuals of one page, so that no window is larger than a document."""
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("manual"), F.lit(1).alias("page_index"), T.normalize(F.col("text")).alias("text"))


def text_normalize(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("text"))


def token_stats(spark, sf_dir):
    t = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", T.token_count(t).cast("long").alias("n_tokens"), F.size(T.terms(t)).cast("long").alias("n_terms"), F.round(T.alpha_ratio(t), 6).alias("alpha")
    )


def page_filter(spark, sf_dir):
    return ingest.filter_pages(_pages(spark, sf_dir), 100).select("source", "page_index", F.md5("text").alias("text_md5"))


def skip_leading(spark, sf_dir):
    return ingest.skip_leading(_pages(spark, sf_dir), ["src0", "src3.pdf"], 100).select("source", "page_index")


def line_flags(spark, sf_dir):
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = T.strip(F.col("line"))
    return lines.select("doc_id", "pos", T.is_heading(line).alias("heading"), T.is_noise(line).alias("noise"))


def heading_samples(spark, sf_dir):
    """Lines that show each rule, made from orders: dates, numbers, codes and titles."""
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = [
        F.concat(key, F.lit(" Rotor")), F.concat(F.lit("Contents ....... "), key), F.concat(F.lit("1.2 ("), day, F.lit(")")), day, F.concat(F.lit("Page "), key, F.lit(" of 9")), F.concat(F.lit("AB-CD12-"), F.col("o_orderpriority")),
        F.concat(F.lit("Fig. "), key), F.concat(F.lit("Table "), key), F.concat(F.lit("IV. "), F.col("o_orderpriority")), F.concat(F.lit("B. part "), key), F.concat(F.lit("Lesson "), key), F.upper(F.concat(F.lit("safety & "), F.col("o_orderpriority"))),
        F.concat(key, F.lit(" / 12")), F.concat(F.lit("see www.x.org "), key, F.lit("/7")), F.lpad(key, 7, "0"),
    ]
    lines = o.select("o_orderkey", F.posexplode(F.array(*forms)).alias("form", "line"))
    return lines.select("o_orderkey", "form", T.is_heading(F.col("line")).alias("heading"), T.is_noise(F.col("line")).alias("noise"))


_SAMPLES_SQL = f"""
WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS p FROM orders),
l AS (SELECT o_orderkey, unnest(range(15)) AS form, unnest([k || ' Rotor', 'Contents ....... ' || k, '1.2 (' || d || ')', d, 'Page ' || k || ' of 9', 'AB-CD12-' || p,
  'Fig. ' || k, 'Table ' || k, 'IV. ' || p, 'B. part ' || k, 'Lesson ' || k, upper('safety & ' || p), k || ' / 12', 'see www.x.org ' || k || '/7', lpad(k, 7, '0')]) AS raw FROM o),
s AS (SELECT o_orderkey, form::INT AS form, {S.strip('raw')} AS line FROM l)
SELECT o_orderkey, form, {S.is_heading('line')} AS heading, {S.is_noise('line')} AS noise FROM s"""


def common_lines(spark, sf_dir):
    """Lines that pages of a source share; at 80 % of the pages documents share none, so any two pages count here."""
    return ingest.common_lines(_pages(spark, sf_dir), share=0.0, least_pages=1)


def clean_pages(spark, sf_dir):
    """Every page gets its source's running title, which then must go again."""
    titled = _pages(spark, sf_dir).withColumn("text", F.concat(F.lit("Manual "), F.col("source"), F.lit("\nPage 3 of 9\n"), F.col("text")))
    return ingest.clean_pages(titled).select("source", "page_index", F.md5("text").alias("text_md5"))


_CLEAN_SQL = f"""
WITH p AS (SELECT source, doc_id::INT AS page_index, 'Manual ' || source || chr(10) || 'Page 3 of 9' || chr(10) || {S.normalize('text')} AS text FROM documents),
l AS (SELECT source, page_index, pos, {S.strip('raw')} AS line, raw FROM
  (SELECT source, page_index, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM p)),
k AS (SELECT * FROM l WHERE NOT {S.is_noise('line')}),
t AS (SELECT source, count(DISTINCT page_index) AS total FROM k GROUP BY source),
c AS (SELECT source, line FROM k JOIN t USING (source) WHERE length(line) <= 80 GROUP BY source, line, total
  HAVING total >= 5 AND count(DISTINCT page_index) >= greatest(2, ceil(total * 0.8))),
r AS (SELECT k.* FROM k ANTI JOIN c USING (source, line)),
a AS (SELECT source, page_index, string_agg(raw, chr(10) ORDER BY pos) AS text FROM r GROUP BY ALL)
SELECT source, page_index, md5({S.normalize('text')}) AS text_md5 FROM a WHERE {S.normalize('text')} <> ''"""


def _titled(spark, sf_dir):
    """A numbered heading before every third line, so that documents have blocks."""
    own = _own_manual(spark, sf_dir)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat((i + 1).cast("string"), F.lit(" Section\n"), x)).otherwise(x))
    return own.withColumn("text", F.array_join(lines, "\n"))


_TITLED_SQL = f"""
d AS (SELECT doc_id AS manual, string_split({S.normalize('text')}, chr(10)) AS ls FROM documents),
x AS (SELECT manual, unnest(range(len(ls))) AS i, unnest(ls) AS raw FROM d),
y AS (SELECT manual, i, unnest(CASE WHEN i % 3 = 0 THEN [(i + 1) || ' Section', raw] ELSE [raw] END) AS raw, unnest(CASE WHEN i % 3 = 0 THEN [0, 1] ELSE [1] END) AS part FROM x),
l AS (SELECT manual, i * 2 + part AS pos, {S.strip('raw')} AS line FROM y WHERE {S.strip('raw')} <> ''),
h AS (SELECT *, {S.is_heading('line')} AS head FROM l),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY manual ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM h),
b AS (SELECT manual, (row_number() OVER (PARTITION BY manual ORDER BY island) - 1)::INT AS block_no, min_by(CASE WHEN head THEN line END, pos) AS heading, string_agg(line, ' ' ORDER BY pos) AS text
  FROM (SELECT manual, island, pos, line, head, arg_min(head, pos) OVER (PARTITION BY manual, island) FROM n) GROUP BY manual, island)"""


def blocks_by_heading(spark, sf_dir):
    return ingest.split_blocks(_titled(spark, sf_dir), "manual").select("manual", "block_no", "heading", F.md5("text").alias("text_md5"))


def outline_blocks(spark, sf_dir):
    """Conversations as manuals: turns are pages and users' turns start sections."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), (F.col("turn") + 1).alias("page_index"), "role", T.normalize(F.col("text")).alias("text"))
    outline = turns.where("role = 'user'").select("source", "page_index", F.substring("text", 1, 40).alias("title"), F.lit(0).alias("entry_no"))
    blocks = ingest.outline_blocks(turns, outline)
    return blocks.select("source", "block_no", "page_index", "page_end", "heading", F.md5("text").alias("text_md5"))


_OUTLINE_SQL = f"""
WITH p AS (SELECT conv_id AS source, turn + 1 AS page_index, role, {S.normalize('text')} AS text FROM conversations),
e AS (SELECT source, page_index, substr(text, 1, 40) AS heading, coalesce(lead(page_index) OVER (PARTITION BY source ORDER BY page_index) - 1, m) AS page_end
  FROM p JOIN (SELECT source, max(page_index) AS m FROM p GROUP BY source) USING (source) WHERE role = 'user'),
j AS (SELECT e.source, e.page_index, e.page_end, e.heading, string_agg(p.text, ' ' ORDER BY p.page_index) AS text FROM e JOIN p
  ON p.source = e.source AND p.page_index BETWEEN e.page_index AND e.page_end AND p.text <> '' WHERE e.page_end >= e.page_index GROUP BY ALL)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY page_index) - 1)::INT AS block_no, page_index, page_end, heading, md5(text) AS text_md5 FROM j"""


def merge_small_blocks(spark, sf_dir):
    merged = ingest.merge_blocks(ingest.split_blocks(_titled(spark, sf_dir), "manual"), "manual")
    return merged.select("manual", "block_no", "heading", T.token_count(F.col("text")).cast("long").alias("n_tokens"), F.md5("text").alias("text_md5"))


_MERGE_SQL = f"""
WITH RECURSIVE {_TITLED_SQL},
s AS (SELECT *, len({S.tokens('text')}) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum FROM b),
f AS (SELECT manual, block_no, 0 AS grp, n, letters, alnum, n >= 60 AND coalesce(letters / nullif(alnum, 0), 0) >= 0.6 AS done FROM s WHERE block_no = 0
  UNION ALL SELECT s.manual, s.block_no, f.grp + f.done::INT, s.n + CASE WHEN f.done THEN 0 ELSE f.n END, s.letters + CASE WHEN f.done THEN 0 ELSE f.letters END,
    s.alnum + CASE WHEN f.done THEN 0 ELSE f.alnum END,
    s.n + CASE WHEN f.done THEN 0 ELSE f.n END >= 60 AND coalesce((s.letters + CASE WHEN f.done THEN 0 ELSE f.letters END) / nullif(s.alnum + CASE WHEN f.done THEN 0 ELSE f.alnum END, 0), 0) >= 0.6
  FROM f JOIN s ON s.manual = f.manual AND s.block_no = f.block_no + 1),
m AS (SELECT f.manual, f.grp AS block_no, arg_min(s.heading, s.block_no) FILTER (s.heading IS NOT NULL) AS heading, string_agg(s.text, ' ' ORDER BY s.block_no) AS text
  FROM f JOIN s USING (manual, block_no) GROUP BY f.manual, f.grp)
SELECT manual, block_no, heading, len({S.tokens('text')})::BIGINT AS n_tokens, md5(text) AS text_md5 FROM m"""


def _whole_blocks(spark, sf_dir):
    return _own_manual(spark, sf_dir).select("manual", F.lit(0).alias("block_no"), "page_index", F.col("page_index").alias("page_end"), F.lit("Safety and inspection").alias("heading"), "text")


def chunk_sliding(spark, sf_dir):
    chunks = ingest.chunk_blocks(_whole_blocks(spark, sf_dir), "manual")
    return chunks.select("chunk_id", "chunk_index", "chunk_kind", F.md5("text").alias("text_md5"))


def chunk_section_plus(spark, sf_dir):
    chunks = ingest.chunk_blocks(_whole_blocks(spark, sf_dir).withColumn("heading", F.lit(None).cast("string")), "manual", sections=True)
    return chunks.select("chunk_id", "chunk_index", "chunk_kind", F.md5("text").alias("text_md5"))


def _chunk_sql(sections: bool, heading: str) -> str:
    parts = "SELECT manual, t, i * 380 AS start, t[i * 380 + 1 : i * 380 + 450] AS part FROM (SELECT manual, t, unnest(range(1 + CASE WHEN len(t) <= 450 THEN 0 ELSE ceil((len(t) - 450) / 380)::INT END)) AS i FROM d)"
    if sections:
        parts = f"SELECT * FROM ({parts}) WHERE NOT (len(t) BETWEEN 120 AND 450) UNION ALL SELECT manual, t, -1, t FROM d WHERE len(t) BETWEEN 120 AND 800"
    return f"""
WITH d AS (SELECT doc_id AS manual, {S.tokens(S.normalize('text'))} AS t FROM documents),
c AS (SELECT manual, start, array_to_string(part, ' ') AS text FROM ({parts}) WHERE len(t) > 0),
n AS (SELECT *, (row_number() OVER (PARTITION BY manual ORDER BY start) - 1)::INT AS chunk_index FROM c)
SELECT printf('manuals::%s::chunk_%06d', manual::VARCHAR, chunk_index) AS chunk_id, chunk_index, {S.chunk_kind(heading, 'text')} AS chunk_kind, md5(text) AS text_md5 FROM n"""


def chunk_kinds(spark, sf_dir):
    """Parts stand for sections and texts that hold the words of each rule in turn."""
    words = F.array(*[F.lit(w) for w in _SAMPLE_WORDS])
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(words, (F.col("p_partkey") % len(_SAMPLE_WORDS) + 1).cast("int")).alias("w"), "p_name", "p_size")
    section = F.when(F.col("p_size") % 2 == 0, F.concat(F.initcap("w"), F.lit(" "), F.col("p_name")))
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 1, F.col("w")), F.lit("end"))
    return p.select("p_partkey", T.chunk_kind(section, text).alias("chunk_kind"))


_SAMPLE_WORDS = (
    "procedure", "work instruction", "check list", "trouble shooting", "stop criteria", "inspection", "step-by-step", "12) do", "if it then", "symptom: x", "ppe", "inspection method", "glossary",
    "revision history", "training", "hazard", "reinspections", "proceduresx", "course", "none",
)
_KINDS_SQL = f"""
WITH p AS (SELECT p_partkey, p_name, p_size, ([{', '.join(S.quoted(w) for w in _SAMPLE_WORDS)}])[p_partkey % {len(_SAMPLE_WORDS)} + 1] AS w FROM part),
q AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN w || ' ' || p_name END AS section, concat_ws(' ', p_name, CASE WHEN p_size % 2 = 1 THEN w END, 'end') AS text FROM p)
SELECT p_partkey, {S.chunk_kind('section', 'text')} AS chunk_kind FROM q"""


def simple_terms(spark, sf_dir):
    own = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("The yaw misalignment near the leading edge: "), F.col("text")).alias("text"))
    return own.select("doc_id", F.array_join(T.simple_terms(F.col("text"), 40), "|").alias("terms"))


_TERMS_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower('The yaw misalignment near the leading edge: ' || coalesce(text, '')), '[a-z]+(?:-[a-z]+)?|\\d+(?:\\.\\d+)?|°'),
    lambda t: NOT list_contains([{', '.join(S.quoted(w) for w in T.STOP_WORDS)}], t) AND length(t) > 2) AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(list_transform(range(1, greatest(len(w), 1)), lambda i: CASE WHEN regexp_full_match(w[i], '[a-z]+') AND regexp_full_match(w[i + 1], '[a-z]+')
    THEN w[i] || ' ' || w[i + 1] END), lambda x: x IS NOT NULL) AS pairs FROM d),
a AS (SELECT doc_id, list_concat(list_concat(list_filter(pairs, lambda x: {' OR '.join(f"contains(x, {S.quoted(k)})" for k in T.PRIORITY_PHRASES)}), pairs), w) AS items FROM p),
u AS (SELECT doc_id, item, min(pos) AS pos FROM (SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM a) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM u)
SELECT doc_id, string_agg(item, '|' ORDER BY n) AS terms FROM r WHERE n <= 40 GROUP BY doc_id"""


def snippets(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.safe_name(F.substring("text", 1, 30)).alias("name"))


def json_payloads(spark, sf_dir):
    """The JSON inside a talkative answer, and a field of it if it is valid, which every fifth is not."""
    broken = F.when(F.col("event_id") % 5 == 0, F.regexp_replace("props", '"k"', '"k')).otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Sure: "), broken, F.lit(" done")).alias("answer"))
    body = T.json_in(F.col("answer"))
    return e.select("event_id", body.alias("body"), F.from_json(body, "k long")["k"].alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, token_stats, page_filter, skip_leading, line_flags, heading_samples, common_lines, clean_pages, blocks_by_heading, outline_blocks, merge_small_blocks, chunk_sliding,
        chunk_section_plus, chunk_kinds, simple_terms, snippets, json_payloads,
    )
}

ORACLES = {
    "text_normalize": f"SELECT doc_id, {S.normalize('text')} AS text FROM documents",
    "token_stats": f"SELECT doc_id, len({S.tokens('text')})::BIGINT AS n_tokens, len({S.terms('text')})::BIGINT AS n_terms, round({S.alpha_ratio('text')}, 6) AS alpha FROM documents",
    "page_filter": f"SELECT source, doc_id::INT AS page_index, md5({S.normalize('text')}) AS text_md5 FROM documents WHERE len({S.tokens('text')}) >= 100",
    "skip_leading": "SELECT source, doc_id::INT AS page_index FROM documents WHERE source NOT IN ('src0', 'src3') OR doc_id > 100",
    "line_flags": f"""WITH l AS (SELECT doc_id, (unnest(range(len(string_split(text, chr(10))))))::INT AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
s AS (SELECT doc_id, pos, {S.strip('raw')} AS line FROM l) SELECT doc_id, pos, {S.is_heading('line')} AS heading, {S.is_noise('line')} AS noise FROM s""",
    "heading_samples": _SAMPLES_SQL,
    "common_lines": f"""WITH l AS (SELECT source, doc_id, {S.strip('raw')} AS line FROM (SELECT source, doc_id, unnest(string_split({S.normalize('text')}, chr(10))) AS raw FROM documents))
SELECT source, line, count(DISTINCT doc_id) AS pages FROM l WHERE line <> '' AND length(line) <= 80 GROUP BY ALL HAVING pages >= 2""",
    "clean_pages": _CLEAN_SQL,
    "blocks_by_heading": f"WITH {_TITLED_SQL} SELECT manual, block_no, heading, md5(text) AS text_md5 FROM b",
    "outline_blocks": _OUTLINE_SQL,
    "merge_small_blocks": _MERGE_SQL,
    "chunk_sliding": _chunk_sql(False, "'Safety and inspection'"),
    "chunk_section_plus": _chunk_sql(True, "NULL"),
    "chunk_kinds": _KINDS_SQL,
    "simple_terms": _TERMS_SQL,
    "snippets": """SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(replace(text, chr(10), ' '), 1, 240) || '...' ELSE replace(text, chr(10), ' ') END AS snippet,
regexp_replace(substr(text, 1, 30), '[^a-zA-Z0-9_.-]+', '_', 'g') AS name FROM documents""",
    "json_payloads": """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN replace(props, '"k"', '"k') ELSE props END AS body FROM events)
SELECT event_id, body, CASE WHEN json_valid(body) THEN (body->>'k')::BIGINT END AS k FROM e""",
}
