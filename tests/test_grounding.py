"""Answers in JSON against closed schemas."""

from pyspark.sql import functions as F

from fathom.operators import grounding as G

_FULL = '{"query": "q", "must_terms": [], "should_terms": ["x"], "exclude_terms": [], "extracted_facts": {"codes": ["a"], "scada_terms": [], "image_terms": [], "notes_terms": [], "key_metrics": [{"name": "u", "value": 2.5}]}}'


def _faults(spark, schema, answers):
    rows = spark.createDataFrame(list(enumerate(answers)), "id int, answer string")
    return [r[1] for r in rows.select("id", G.schema_errors(F.col("answer"), schema).alias("faults")).orderBy("id").collect()]


def test_an_answer_is_parsed_once(spark):
    made = spark.createDataFrame([(_FULL,)], "answer string").select(G.schema_errors(F.col("answer"), G.QUERY_PACK).alias("faults"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_odd_answers_have_the_faults_they_had(spark):
    facts = ["$.extracted_facts: missing"]
    terms = [f"$.{k}_terms: missing" for k in ("must", "should", "exclude")]
    answers = {
        _FULL: [],
        None: ["$: not a object"],
        "": ["$: not a object"],
        "null": ["$: not a object"],
        "[]": ["$: not a object"],
        "{}": ["$.query: missing", *terms, *facts],
        '{"query": "a", "query": "b"}': ["$: not a object"],
        '{"query": null, "zz": 1, "": 2, "must_terms": {}, "should_terms": [null, [], "x", 1], "exclude_terms": null, "extracted_facts": []}': [
            "$.: not expected", "$.zz: not expected", "$.query: not a text", "$.must_terms: not a list", "$.should_terms[0]: not a text", "$.should_terms[1]: not a text", "$.should_terms[3]: not a text",
            "$.exclude_terms: not a list", "$.extracted_facts: not a object",
        ],
        _FULL.replace('"value": 2.5', '"value": true, "unit": "m"'): ["$.extracted_facts.key_metrics[0].unit: not expected", "$.extracted_facts.key_metrics[0].value: not a number"],
        _FULL.replace('{"name": "u", "value": 2.5}', "{}, 3"): ["$.extracted_facts.key_metrics[0].name: missing", "$.extracted_facts.key_metrics[0].value: missing", "$.extracted_facts.key_metrics[1]: not a object"],
    }
    assert _faults(spark, G.QUERY_PACK, [*answers, _FULL]) == [*answers.values(), []]  # the first answer comes twice
    codes = {'{"diagnosis": "x"}': [], '{"diagnosis": "x", "risk_code": "no_risk"}': [], '{"diagnosis": "x", "risk_code": "none"}': ["$.risk_code: not allowed"], '{"diagnosis": "x", "risk_code": 1}': ["$.risk_code: not a text"]}
    assert _faults(spark, G.DIAGNOSIS, codes) == [*codes.values()]
