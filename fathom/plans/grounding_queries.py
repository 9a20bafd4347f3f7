"""Queries over payloads and answers: documents play chunks, answers are made from hits by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import grounding as G
from fathom.operators import retrieval as R
from fathom.plans import retrieval_queries as RQ
from fathom.sources.tables import table
from fathom.staging import staged


def _hits(spark, sf_dir):
    """The ten best documents of each benchmark item, as chunks."""
    docs = RQ._docs(spark, sf_dir)
    top = R.top(R.bm25(docs, RQ._asks(spark, sf_dir)), 10, "bm25").join(docs, "doc_id")
    name = F.format_string("manuals::%s::chunk_%06d", "source", "doc_id")
    none = F.lit(None).cast("string")
    return staged(top.select("query_id", "rank", "doc_id", name.alias("chunk_id"), "source", F.col("doc_id").alias("page"), (F.col("doc_id") + 1).alias("page_end"), none.alias("section"), F.lit("other").alias("chunk_kind"), "text"), "hits")


def report_payloads(spark, sf_dir):
    made = G.report_payloads(RQ._asks(spark, sf_dir), _hits(spark, sf_dir), 3, 200)
    at = lambda p: F.get_json_object("payload", p)
    n = F.size(F.from_json(at("$.chunks"), "array<string>"))
    return made.select("query_id", F.md5(at("$.query")).alias("query_md5"), n.cast("long").alias("n"), at("$.chunks[0].chunk_id").alias("first"), F.md5(at("$.chunks[1].text")).alias("text_md5"), at("$.output_schema.summary").alias("form"))


def advice_payloads(spark, sf_dir):
    contexts = RQ._asks(spark, sf_dir).select("query_id", F.struct(F.col("query_id").alias("case"), F.length("query_text").alias("size")).alias("context"))
    made = G.advice_payloads(contexts, _hits(spark, sf_dir), 3, 200)
    return made.select("query_id", F.get_json_object("payload", "$.context.size").cast("long").alias("size"), F.md5(F.get_json_object("payload", "$.retrieved_chunks[2]")).alias("block_md5"))


def citations(spark, sf_dir):
    """Every answer cites its third and its first hit; each third one a chunk that it was not given, each fifth none at all."""
    hits = _hits(spark, sf_dir)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("chunk_id")))
    per = hits.groupBy("query_id").agg(at(1).alias("one"), at(3).alias("three"))
    text = F.concat_ws(
        "", F.lit("Stop first ["), "three", F.lit("]. Then look [1] at ["), "one", F.lit("] and ["), "three", F.lit("]"),
        F.when(F.col("query_id") % 3 == 0, F.concat(F.lit(" or [manuals::none::chunk_"), F.col("query_id").cast("string"), F.lit("]"))),
    )
    answers = per.select("query_id", F.when(F.col("query_id") % 5 == 0, F.lit("No idea.")).otherwise(text).alias("answer"))
    found = G.citations(answers, hits)
    return found.select("query_id", *(F.array_join(c, " ").alias(c) for c in ("known", "unknown")), F.size("unused").cast("long").alias("n_unused"), "grounded")


_ANSWERS = (
    '{"diagnosis": "Blade is fine.", "risk_code": "no_risk"}', '{"risk_code": "low_risk"}', '{"diagnosis": "x", "risk_code": "high_risk", "cause": 1}', '{"diagnosis": " ", "risk_code": "unknown"}',
    "not json", '{"diagnosis": 7}', '[1]', '{"diagnosis": "No code."}',
)
_FAULTS = ("", "$.diagnosis: missing", "$.cause: not expected", "$.risk_code: not allowed", "$: not a object", "$.diagnosis: not a text", "$: not a object", "")
_RISKS = ("Blade is fine./no_risk", "(no diagnosis)/low_risk", "x/high_risk", "(no diagnosis)/not_classified", "(no diagnosis)/not_classified", "7/not_classified", "(no diagnosis)/not_classified", "No code./not_classified")


def answer_faults(spark, sf_dir):
    """Eight answers, dealt out to events, against the closed schema of a diagnosis."""
    ev = table(spark, sf_dir, "events").select("event_id", F.element_at(F.lit(list(_ANSWERS)), (F.col("event_id") % 8 + 1).cast("int")).alias("answer"))
    risk = G.risk_of(F.col("answer"))
    return ev.select("event_id", F.array_join(G.schema_errors(F.col("answer"), G.DIAGNOSIS), "; ").alias("faults"), F.concat(risk["diagnosis"], F.lit("/"), risk["risk_code"]).alias("risk"))


def query_pack_faults(spark, sf_dir):
    """Query packs made of events; the metric of every other one is a text, each third fact has a key too many."""
    ev = table(spark, sf_dir, "events")
    n = F.col("event_id")
    metric = F.concat(F.lit('{"name": "v", "value": '), F.when(n % 2 == 0, F.lit("1.5")).otherwise(F.lit('"1.5"')), F.lit("}"))
    facts = F.concat(F.lit('{"codes": ["a"], "scada_terms": [], "image_terms": [], "notes_terms": [], "key_metrics": [{"name": "u", "value": 2}, '), metric, F.lit("]"), F.when(n % 3 == 0, F.lit(', "more": true')).otherwise(""), F.lit("}"))
    pack = F.concat(F.lit('{"query": "'), "event_type", F.lit('", "must_terms": [], "should_terms": ["x", '), F.when(n % 5 == 0, "1").otherwise('"y"'), F.lit('], "exclude_terms": [], "extracted_facts": '), facts, F.lit("}"))
    return ev.select("event_id", F.array_join(G.schema_errors(pack, G.QUERY_PACK), "; ").alias("faults"))


def resolved_cases(spark, sf_dir):
    """Customers ask for windows; suppliers have cards, parts are samples, some requests bring their own case."""
    c = table(spark, sf_dir, "customer")
    own = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit('{"case": {"summary": " own '), F.col("c_custkey").cast("string"), F.lit(' "}}'))).when(F.col("c_custkey") % 11 == 0, "  ")
    requests = c.select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("w"), F.col("c_custkey") % 1000).alias("window_id"), own.alias("inline"))
    cards = table(spark, sf_dir, "supplier").select(F.concat(F.lit("w"), F.col("s_suppkey") * 3).alias("window_id"), F.concat(F.lit('{"summary": "", "event_label": "card '), "s_suppkey", F.lit('"}')).alias("card"))
    samples = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nth"), F.concat(F.lit("w"), F.col("p_partkey") % 500 * 2).alias("id"), F.concat(F.lit('{"summary": "part '), "p_partkey", F.lit('"}')).alias("case"))
    return G.resolve_cases(requests, cards, samples).select("request_id", "origin", G.case_summary(F.col("case")).alias("summary"))


QUERIES = {f.__name__: f for f in (report_payloads, advice_payloads, citations, answer_faults, query_pack_faults, resolved_cases)}

_H = f"""{RQ._bm25_sql(RQ._BATCH)},
h AS (SELECT query_id, rank, doc_id, 'manuals::' || source || '::chunk_' || lpad(doc_id::VARCHAR, 6, '0') AS chunk_id, source, text FROM (SELECT *, {RQ._TOP.format('bm25', 'doc_id')} FROM sc) JOIN documents USING (doc_id) WHERE rank <= 10)"""


def _chosen(values: tuple[str, ...]) -> str:
    return f"[{', '.join(RQ.S.quoted(v) for v in values)}][event_id % 8 + 1]"


ORACLES = {
    "report_payloads": f"""WITH {_H}
SELECT a.query_id, md5(a.query_text) AS query_md5, count(h.rank) AS n, max(chunk_id) FILTER (rank = 1) AS first, md5(max(substr(text, 1, 200)) FILTER (rank = 2)) AS text_md5, 'string' AS form
FROM asks a LEFT JOIN h ON a.query_id = h.query_id AND rank <= 3 GROUP BY a.query_id, a.query_text""",
    "advice_payloads": f"""WITH {_H}
SELECT a.query_id, length(a.query_text)::BIGINT AS size, md5(max('CHUNK 3: [' || source || ' p' || doc_id || '-' || (doc_id + 1) || '] ' || chr(10) || substr(text, 1, 200) || chr(10)) FILTER (rank = 3)) AS block_md5
FROM asks a LEFT JOIN h ON a.query_id = h.query_id GROUP BY a.query_id, a.query_text""",
    "citations": f"""WITH {_H},
per AS (SELECT query_id, count(*) AS n, max(chunk_id) FILTER (rank = 1) AS one, max(chunk_id) FILTER (rank = 3) AS three FROM h GROUP BY query_id),
cites AS (SELECT *, CASE WHEN query_id % 5 = 0 THEN NULL ELSE concat_ws(' ', three, one) END AS k, CASE WHEN query_id % 5 <> 0 AND query_id % 3 = 0 THEN 'manuals::none::chunk_' || query_id END AS u FROM per)
SELECT query_id, coalesce(k, '') AS known, coalesce(u, '') AS unknown, n - CASE WHEN k IS NULL THEN 0 WHEN three IS NULL THEN 1 ELSE 2 END AS n_unused, k IS NOT NULL AND u IS NULL AS grounded FROM cites""",
    "answer_faults": f"SELECT event_id, {_chosen(_FAULTS)} AS faults, {_chosen(_RISKS)} AS risk FROM events",
    "query_pack_faults": """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 5 = 0 THEN '$.should_terms[1]: not a text' END, CASE WHEN event_id % 3 = 0 THEN '$.extracted_facts.more: not expected' END,
CASE WHEN event_id % 2 = 1 THEN '$.extracted_facts.key_metrics[1].value: not a number' END) AS faults FROM events""",
    "resolved_cases": """WITH q AS (SELECT c_custkey AS id, 'w' || c_custkey % 1000 AS w, c_custkey % 7 = 0 AS own FROM customer),
k AS (SELECT 'w' || s_suppkey * 3 AS w, 'card ' || s_suppkey AS card FROM supplier), s AS (SELECT 'w' || p_partkey % 500 * 2 AS w, 'part ' || min(p_partkey) AS sample FROM part GROUP BY 1)
SELECT id AS request_id, CASE WHEN own THEN 'inline' WHEN card IS NOT NULL THEN 'card' WHEN sample IS NOT NULL THEN 'sample' ELSE 'none' END AS origin,
CASE WHEN own THEN 'own ' || id ELSE coalesce(card, sample, '') END AS summary FROM q LEFT JOIN k USING (w) LEFT JOIN s USING (w)""",
}
