"""Queries over sensor windows: line items play readings, suppliers datasets; events play a single sensor of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import timeseries as X
from fathom.sources.tables import table

S = X.Sensors()
_READINGS = {
    "wind": "l_quantity", "wind_std": "l_tax * 10", "wind_max": "l_quantity + l_tax * 20", "wind_4": "l_quantity * 0.9D + l_discount * 10", "power": "l_extendedprice / 1000", "power_std": "l_discount * 50",
    "rotor": "l_quantity / 4 + l_linenumber", "rotor_std": "l_linenumber * 0.1D", "gen": "l_extendedprice / 500", "gen_std": "l_tax * 5", "pitch": "l_linenumber * 2.0D", "pitch_std": "l_discount",
    "temp_1": "20 + l_tax * 100", "temp_2": "25 + l_discount * 100", "temp_3": "30.0D + l_linenumber", "temp_4": "35 + l_quantity / 7",
}


def _rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    id_ = F.row_number().over(X.Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber"))
    return li.select(
        F.col("l_suppkey").alias("dataset_id"), id_.alias("id"), F.col("l_shipdate").alias("ts"),
        F.expr("case when l_shipdate < timestamp_ntz'1997-01-01' then 'train' else 'prediction' end").alias("train_test"),
        F.expr("nullif(l_linenumber, 7) - 1").alias("status_type_id"), *(F.expr(e).cast("double").alias(n) for n, e in _READINGS.items()),
        F.expr("cast(pmod(l_orderkey * 7, 360) as double)").alias("wind_dir"), F.expr("cast(pmod(l_partkey * 11, 360) as double)").alias("nacelle_dir"),
    )


def _sql_readings() -> str:
    return ", ".join(f"({e.replace('0.9D', '0.9::DOUBLE').replace('0.1D', '0.1::DOUBLE').replace('2.0D', '2.0::DOUBLE').replace('30.0D', '30.0::DOUBLE')})::DOUBLE AS {n}" for n, e in _READINGS.items())


_ROWS = f"""
rows AS (SELECT l_suppkey AS dataset_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))::INT AS id, l_shipdate AS ts,
  CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'prediction' END AS train_test, nullif(l_linenumber, 7) - 1 AS status, {_sql_readings()},
  (l_orderkey * 7 % 360)::DOUBLE AS wind_dir, (l_partkey * 11 % 360)::DOUBLE AS nacelle_dir FROM lineitem),
model AS (SELECT dataset_id, coalesce(regr_slope(power, wind), 0) AS slope, coalesce(regr_intercept(power, wind), avg(power), 0) AS intercept FROM rows WHERE train_test = 'train' GROUP BY dataset_id),
d AS (SELECT rows.*, (power - (slope * wind + intercept)) / greatest(abs(slope * wind + intercept), 1) AS residual,
  abs(((wind_dir - nacelle_dir + 180) % 360 + 360) % 360 - 180) AS yaw, (temp_1 + temp_2 + temp_3 + temp_4) / 4 AS temp FROM rows JOIN model USING (dataset_id)),
base AS (SELECT dataset_id, {', '.join(f"avg({f}) AS mean_{f}, coalesce(nullif(stddev_samp({f}), 0), 1) AS std_{f}" for f in S.features)},
  {', '.join(f"avg({c}) AS b_{n}_mean, CASE WHEN stddev_samp({c}) = 0 THEN 1 ELSE stddev_samp({c}) END AS b_{n}_std" for n, c in (('wind', 'wind'), ('power', 'power'), ('pitch', 'pitch'), ('power_std', 'power_std'), ('wind_std', 'wind_std'), ('yaw', 'yaw'), ('temp', 'temp'), ('rotor', 'rotor'), ('gen', 'gen')))},
  avg(residual) AS b_residual_mean, stddev_pop(residual) AS b_residual_std, coalesce(count(*) FILTER (status NOT IN (0, 2)) / nullif(count(status), 0), 0) AS b_status_ratio
  FROM d WHERE train_test = 'train' GROUP BY dataset_id),
an AS (SELECT d.*, ({' + '.join(f"abs(({f} - mean_{f}) / std_{f})" for f in S.features)}) / {len(S.features)} AS anomaly,
  row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS nth FROM d JOIN base USING (dataset_id) WHERE train_test = 'prediction'),
ro AS (SELECT *, CASE WHEN nth >= 36 THEN avg(anomaly) OVER (PARTITION BY dataset_id ORDER BY id ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) END AS roll FROM an)"""
_BEST = _ROWS + """,
be AS (SELECT * FROM (SELECT dataset_id, nth AS last, roll AS score, row_number() OVER (PARTITION BY dataset_id ORDER BY round(roll, 9) {order}, nth) AS k FROM ro WHERE roll IS NOT NULL) WHERE k = 1),
wi AS (SELECT ro.*, score FROM ro JOIN be USING (dataset_id) WHERE nth BETWEEN last - 35 AND last)"""
_HOT, _CALM = _BEST.replace("{order}", "DESC"), _BEST.replace("{order}", "ASC")
_PAIRS = (("wind_speed", "wind"), ("power", "power"), ("rotor_rpm", "rotor"), ("generator_rpm", "gen"), ("pitch", "pitch"), ("yaw_misalignment", "yaw"))
_METRICS = _HOT + f""",
me AS (SELECT dataset_id, arg_min(ts, id) AS start_time, arg_max(ts, id) AS end_time, min(id) AS start_id, max(id) AS end_id, count(*) AS row_count,
  {', '.join(f"round(avg({c}), 4) AS {n}_mean, round(stddev_samp({c}), 4) AS {n}_std" for n, c in _PAIRS)}, round(max(wind_max), 4) AS wind_speed_max, round(avg(temp), 4) AS temp_mean,
  avg(residual) AS rm, stddev_pop(residual) AS rs, coalesce(count(*) FILTER (status NOT IN (0, 2)) / nullif(count(status), 0), 0) AS odd FROM wi GROUP BY dataset_id),
zs AS (SELECT me.*, (rm - b_residual_mean) / b_residual_std AS z_power_residual_mean, (wind_speed_mean - b_wind_mean) / b_wind_std AS z_wind_speed_mean,
  (wind_speed_std - b_wind_std_mean) / b_wind_std_std AS z_wind_speed_std, (yaw_misalignment_mean - b_yaw_mean) / b_yaw_std AS z_yaw_misalignment_mean,
  (pitch_mean - b_pitch_mean) / b_pitch_std AS z_pitch_mean, rotor_rpm_std / b_rotor_std AS z_rotor_rpm_std, generator_rpm_std / b_gen_std AS z_generator_rpm_std,
  (me.power_std - b_power_std_mean) / b_power_std_std AS z_power_std, (temp_mean - b_temp_mean) / b_temp_std AS z_temp_mean,
  (odd - b_status_ratio) / greatest(sqrt(b_status_ratio * (1 - b_status_ratio) / greatest(row_count, 1)), 0.05) AS z_status_non_normal_ratio FROM me JOIN base USING (dataset_id)),
sc AS (SELECT *, greatest(0, 1 - abs(z_power_residual_mean + 0.5)) AS mild, greatest(-z_power_residual_mean, 0) AS strong, greatest(z_pitch_mean, 0) AS pp, greatest(z_status_non_normal_ratio, 0) AS sp FROM zs),
cl AS (SELECT *, mild + 0.3 * pp - 0.2 * abs(z_status_non_normal_ratio) AS s1, strong + 0.5 * pp + 0.3 * greatest(z_power_std, 0) AS s2,
  0.5 * greatest(z_wind_speed_mean, 0) + 0.7 * greatest(z_wind_speed_std, 0) + 0.6 * greatest(z_yaw_misalignment_mean, 0) + 0.4 * sp AS s3,
  0.6 * greatest(z_rotor_rpm_std, 0) + 0.6 * greatest(z_generator_rpm_std, 0) + 0.5 * greatest(z_temp_mean, 0) + 0.3 * sp AS s4,
  0.9 * mild - 0.2 * greatest(abs(z_pitch_mean) - 1, 0) - 0.2 * sp AS s5 FROM sc)"""
_Z = ("power_residual_mean", "wind_speed_mean", "wind_speed_std", "yaw_misalignment_mean", "pitch_mean", "rotor_rpm_std", "generator_rpm_std", "power_std", "temp_mean", "status_non_normal_ratio")


def _parts(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    train = rows.where("train_test = 'train'")
    model = X.power_model(train)
    base = X.baseline(train, model)
    scored = X.row_anomaly(X.candidates(rows), base)
    return rows, model, base, scored


def power_model(spark, sf_dir):
    model = _parts(spark, sf_dir)[1]
    return model.select("dataset_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def power_residuals(spark, sf_dir):
    rows, model, _, _ = _parts(spark, sf_dir)
    return rows.join(model, "dataset_id").select("dataset_id", "id", F.round(X.residual(), 6).alias("residual"))


def baseline(spark, sf_dir):
    base = _parts(spark, sf_dir)[2]
    return base.select("dataset_id", *((F.round(c, 5) + 0.0).alias(c) for c in ("mean_wind", "std_wind", "mean_temp_4", "std_gen", "b_yaw_mean", "b_yaw_std", "b_temp_std", "b_residual_mean", "b_residual_std", "b_status_ratio")))


def event_candidates(spark, sf_dir):
    """Every third supplier has an event; of those, every other one is too short to be used."""
    rows = _rows(spark, sf_dir)
    predicted = rows.where("train_test = 'prediction'").groupBy("dataset_id").agg(F.min("id").alias("first_id")).where("dataset_id % 3 = 0")
    events = predicted.select("dataset_id", "first_id", (F.col("first_id") + F.when(F.col("dataset_id") % 2 == 0, 40).otherwise(10)).alias("last_id"))
    return X.candidates(rows, events).select("dataset_id", "id")


def row_anomaly(spark, sf_dir):
    return _parts(spark, sf_dir)[3].select("dataset_id", "id", F.round("anomaly", 6).alias("anomaly"))


def rolling_mean(spark, sf_dir):
    return X.rolling(_parts(spark, sf_dir)[3]).select("dataset_id", "id", F.round("roll", 6).alias("roll"))


def _window(spark, sf_dir, calm):
    window = X.best_window(_parts(spark, sf_dir)[3], calm=calm)
    return window.select("dataset_id", "id", F.round("window_score", 6).alias("window_score"))


def rolling_best_window(spark, sf_dir):
    return _window(spark, sf_dir, False)


def calm_window(spark, sf_dir):
    return _window(spark, sf_dir, True)


def _metrics(spark, sf_dir):
    _, model, base, scored = _parts(spark, sf_dir)
    return X.window_metrics(X.best_window(scored).drop("anomaly", "window_score"), base, model)


def window_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select("dataset_id", "start_id", "end_id", "row_count", "start_time", "end_time", *X.STATS, *("power_residual_mean", "power_residual_std", "status_non_normal_ratio"))


def status_counts(spark, sf_dir):
    return _metrics(spark, sf_dir).select("dataset_id", F.explode("status_counts").alias("code", "n"))


def z_scores(spark, sf_dir):
    return _metrics(spark, sf_dir).select("dataset_id", *(F.round(f"z_{z}", 4).alias(f"z_{z}") for z in _Z))


def class_scores(spark, sf_dir):
    scored = X.class_scores(_metrics(spark, sf_dir))
    return scored.select("dataset_id", *(F.round(F.element_at("scores", c), 4).alias(f"s{k + 1}") for k, c in enumerate(X.CLASSES)))


def window_tags(spark, sf_dir):
    return X.tags(_metrics(spark, sf_dir)).select("dataset_id", F.array_join("tags", ",").alias("tags"))


def select_by_class(spark, sf_dir):
    return X.window_ids(X.select_windows(X.class_scores(_metrics(spark, sf_dir)), 3)).select("class_no", "nth", "window_id")


def select_calm(spark, sf_dir):
    ends = X.best_window(_parts(spark, sf_dir)[3], calm=True).groupBy("dataset_id").agg(F.max("id").alias("end_id"), F.max("window_score").alias("window_score"))
    return X.select_calm(ends, 7)


_CARD_NUMBERS = (*(f"stats.{n}" for n in X.STATS), "derived.power_residual_mean", "derived.power_residual_std")


def cards_json(spark, sf_dir):
    """The nested cards, taken apart again: what a reader of the JSON sees."""
    cards = X.cards(X.tags(_metrics(spark, sf_dir)))
    field = lambda path: F.get_json_object("card", f"$.{path}")
    texts = {"start_time": "window.start_time", "end_time": "window.end_time", "window_end": "source.window_end", "tags": "tags", "statuses": "derived.status_10min_interval_counts", "idling": "derived.status_legend.2"}
    whole = {"dataset_id": "source.dataset_id", "row_count": "window.row_count", "baseline_hours": "window.baseline_hours", "window_hours": "window.window_hours"}
    return cards.select(
        "window_id", *(field(path).alias(n) for n, path in texts.items()), *(field(path).cast("long").alias(n) for n, path in whole.items()),
        *(field(path).cast("double").alias(path.split(".")[1]) for path in _CARD_NUMBERS),
    )


def summary_prompts(spark, sf_dir):
    return X.summary_prompt(X.tags(_metrics(spark, sf_dir)))


def time_slice(spark, sf_dir):
    """The last six hours of every user's events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("id"), "ts")
    return X.time_slice(e, 6).select("dataset_id", "id")


def events_best_window(spark, sf_dir):
    """The 20 events of each user with the highest mean value."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("id"), "ts", F.col("value").alias("anomaly"))
    return X.best_window(e, 20).groupBy("dataset_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.round(F.max("window_score"), 6).alias("score"))


def calm_selection(spark, sf_dir):
    """The best windows of users as calm ones, of which classes have taken those of every other user; more are wanted than there are."""
    ends = events_best_window(spark, sf_dir).select("dataset_id", F.col("last_id").alias("end_id"), F.col("score").alias("window_score"))
    return X.select_calm(ends, 200, taken=ends.where("dataset_id % 2 = 0"))


def angle_differences(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.angle_diff((F.col("l_orderkey") % 720 - 360).cast("double"), (F.col("l_partkey") % 360).cast("double")).alias("angle"))


def number_coercion(spark, sf_dir):
    cell = F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".75"))).otherwise(F.col("o_orderkey").cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell"))
    return o.select("o_orderkey", X.number(F.col("cell")).alias("number"), X.whole(F.col("cell")).cast("long").alias("whole"))


def card_facets(spark, sf_dir):
    """Orders play cards: priorities are tags and the customer's nation is the class."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    listed = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left")
    listed = listed.select(F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.col("n_name").alias("class_label"))
    return X.card_facets(listed).select("facet", F.array_join("values", "|").alias("values"))


QUERIES = {
    f.__name__: f
    for f in (
        power_model, power_residuals, baseline, event_candidates, row_anomaly, rolling_mean, rolling_best_window, calm_window, window_metrics, status_counts, z_scores, class_scores, window_tags,
        select_by_class, select_calm, cards_json, summary_prompts, time_slice, events_best_window, calm_selection, angle_differences, number_coercion, card_facets,
    )
}



_BEST_EVENTS = """WITH e AS (SELECT user_id, event_id, row_number() OVER w AS nth, CASE WHEN row_number() OVER w >= 20 THEN avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS roll
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(roll, 9) DESC, nth) AS k FROM e WHERE roll IS NOT NULL) WHERE k = 1)
SELECT e.user_id AS dataset_id, min(e.event_id) AS first_id, max(e.event_id) AS last_id, round(max(b.roll), 6) AS score FROM e JOIN b ON e.user_id = b.user_id AND e.nth BETWEEN b.nth - 19 AND b.nth GROUP BY e.user_id"""


def _picks_sql(k: int) -> str:
    """The windows of class k in the order in which it takes them, those of earlier classes last, and its three picks."""
    taken = " UNION ALL ".join(f"SELECT dataset_id, end_id FROM p{j}" for j in range(k)) or "SELECT NULL, NULL"
    return f"""o{k} AS (SELECT dataset_id, end_id, row_number() OVER (ORDER BY t.d IS NOT NULL, n) - 1 AS pos, count(*) OVER () AS size FROM r
  LEFT JOIN (SELECT DISTINCT d, e FROM ({taken}) AS x(d, e)) t ON t.d = dataset_id AND t.e = end_id WHERE class_no = {k}),
p{k} AS (SELECT {k} AS class_no, nth, dataset_id, end_id FROM (SELECT unnest([1, 2, 3]) AS nth) JOIN o{k} ON pos = (nth - 1) % size)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _as_spark(number: str) -> str:
    """A number of four decimals as Spark writes doubles; a null is nan."""
    return f"coalesce(CASE WHEN abs({number}) < 0.001 AND {number} <> 0 THEN replace(printf('%.1E', {number}), 'E-0', 'E-') ELSE {number}::DOUBLE::VARCHAR END, 'nan')"


_LEGENDS = " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in X.STATUS_LEGEND.items())
_COUNTS = f"""co AS (SELECT dataset_id, status::VARCHAR AS code, count(*) AS n FROM wi WHERE status IS NOT NULL GROUP BY ALL),
st AS (SELECT dataset_id, string_agg('"' || code || '":' || n, ',' ORDER BY code) AS as_json,
  string_agg(n || ' intervals: ' || CASE code {_LEGENDS} ELSE 'Status ' || code END, '; ' ORDER BY code) AS as_text FROM co GROUP BY dataset_id)"""
_TAG_SQL = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in X.TAGS)
_TAGS_OF = f"list_filter([{_TAG_SQL}], lambda x: x IS NOT NULL)"
ORACLES = {
    "power_model": f"WITH {_ROWS} SELECT dataset_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM model",
    "power_residuals": f"WITH {_ROWS} SELECT dataset_id, id, round(residual, 6) AS residual FROM d",
    "baseline": f"WITH {_ROWS} SELECT dataset_id, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in ('mean_wind', 'std_wind', 'mean_temp_4', 'std_gen', 'b_yaw_mean', 'b_yaw_std', 'b_temp_std', 'b_residual_mean', 'b_residual_std', 'b_status_ratio'))} FROM base",
    "event_candidates": f"""WITH {_ROWS}, p AS (SELECT dataset_id, id FROM rows WHERE train_test = 'prediction'),
ev AS (SELECT dataset_id, min(id) AS a, min(id) + CASE WHEN dataset_id % 2 = 0 THEN 40 ELSE 10 END AS b FROM p WHERE dataset_id % 3 = 0 GROUP BY dataset_id),
m AS (SELECT p.*, coalesce(id BETWEEN a AND b, false) AS inside FROM p LEFT JOIN ev USING (dataset_id)),
k AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY dataset_id) AS n FROM m) SELECT dataset_id, id FROM k WHERE inside OR n < 36""",
    "row_anomaly": f"WITH {_ROWS} SELECT dataset_id, id, round(anomaly, 6) AS anomaly FROM an",
    "rolling_mean": f"WITH {_ROWS} SELECT dataset_id, id, round(roll, 6) AS roll FROM ro",
    "rolling_best_window": f"WITH {_HOT} SELECT dataset_id, id, round(score, 6) AS window_score FROM wi",
    "calm_window": f"WITH {_CALM} SELECT dataset_id, id, round(score, 6) AS window_score FROM wi",
    "window_metrics": f"WITH {_METRICS} SELECT dataset_id, start_id, end_id, row_count, start_time, end_time, {', '.join(X.STATS)}, round(rm, 4) AS power_residual_mean, round(rs, 4) AS power_residual_std, round(odd, 4) AS status_non_normal_ratio FROM me",
    "status_counts": f"WITH {_HOT} SELECT dataset_id, status::VARCHAR AS code, count(*) AS n FROM wi WHERE status IS NOT NULL GROUP BY ALL",
    "z_scores": f"WITH {_METRICS} SELECT dataset_id, {', '.join(f'round(z_{z}, 4) AS z_{z}' for z in _Z)} FROM zs",
    "class_scores": f"WITH {_METRICS} SELECT dataset_id, {', '.join(f'round(s{k}, 4) AS s{k}' for k in range(1, 6))} FROM cl",
    "window_tags": f"WITH {_METRICS} SELECT dataset_id, array_to_string(list_filter([{_TAG_SQL}], lambda x: x IS NOT NULL), ',') AS tags FROM zs",
    "select_by_class": f"""WITH {_METRICS},
w AS (SELECT dataset_id, end_id, unnest([0, 1, 2, 3, 4]) AS class_no, unnest([s1, s2, s3, s4, s5]) AS score FROM cl),
r AS (SELECT class_no, dataset_id, end_id, row_number() OVER (PARTITION BY class_no ORDER BY round(score, 9) DESC, dataset_id, end_id) AS n FROM w),
{', '.join(_picks_sql(k) for k in range(5))},
u AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, end_id ORDER BY class_no, nth) - 1 AS again FROM ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(5))}))
SELECT class_no, nth, 'WF-A-' || dataset_id || '-' || end_id || CASE WHEN again > 0 THEN '-' || again ELSE '' END AS window_id FROM u""",
    "select_calm": f"WITH {_CALM}, e AS (SELECT dataset_id, max(id) AS end_id, max(score) AS score FROM wi GROUP BY dataset_id) SELECT row_number() OVER (ORDER BY round(score, 9), dataset_id) AS nth, dataset_id, end_id FROM e QUALIFY nth <= 7",
    "cards_json": f"""WITH {_METRICS}, {_COUNTS}
SELECT 'WF-A-' || me.dataset_id || '-' || me.end_id AS window_id, strftime(me.start_time, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(me.end_time, '%Y-%m-%d %H:%M:%S') AS end_time,
  strftime(me.end_time, '%Y-%m-%d %H:%M:%S') AS window_end, to_json({_TAGS_OF})::VARCHAR AS tags, '{{' || coalesce(as_json, '') || '}}' AS statuses, {_quoted(X.STATUS_LEGEND['2'])} AS idling, me.dataset_id, me.row_count,
  168 AS baseline_hours, 6 AS window_hours, {', '.join(f'me.{n}' for n in X.STATS)}, round(me.rm, 4) AS power_residual_mean, round(me.rs, 4) AS power_residual_std
FROM me JOIN zs USING (dataset_id) LEFT JOIN st USING (dataset_id)""",
    "summary_prompts": f"""WITH {_METRICS}, {_COUNTS}
SELECT me.dataset_id, {_quoted(X.SUMMARY_ASK)} || {" || ', ' || ".join(f"'{n}=' || {_as_spark('round(me.rm, 4)' if n == 'power_residual_mean' else f'me.{n}')}" for n in X.SUMMARY_STATS)}
  || '. Turbine status (10-min intervals): ' || coalesce(as_text, 'no status data') || '. Tags: ' || coalesce(nullif(array_to_string({_TAGS_OF}, ', '), ''), 'none') || '.' AS prompt
FROM me JOIN zs USING (dataset_id) LEFT JOIN st USING (dataset_id)""",
    "time_slice": """WITH l AS (SELECT user_id, arg_max(ts, event_id) AS last FROM events GROUP BY user_id)
SELECT user_id AS dataset_id, event_id AS id FROM events JOIN l USING (user_id) WHERE ts BETWEEN last - INTERVAL 6 HOURS AND last""",
    "events_best_window": _BEST_EVENTS,
    "calm_selection": f"""WITH q AS (SELECT dataset_id, last_id AS end_id, score FROM ({_BEST_EVENTS})),
r AS (SELECT dataset_id, end_id, row_number() OVER (ORDER BY dataset_id % 2 = 0, score, dataset_id, end_id) AS n, row_number() OVER (ORDER BY score, dataset_id, end_id) AS calm, count(*) OVER () AS size FROM q)
SELECT nth::INT AS nth, dataset_id, end_id FROM (SELECT n AS nth, dataset_id, end_id FROM r UNION ALL SELECT calm + size * k, dataset_id, end_id FROM r, (SELECT unnest(range(1, 200)) AS k)) WHERE nth <= 200""",
    "angle_differences": """SELECT l_orderkey, l_linenumber, abs((((l_orderkey % 720 - 360)::DOUBLE - (l_partkey % 360) + 180) % 360 + 360) % 360 - 180) AS angle FROM lineitem""",
    "number_coercion": """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN o_orderkey || '.75' ELSE o_orderkey::VARCHAR END AS cell FROM orders)
SELECT o_orderkey, try_cast(cell AS DOUBLE) AS number, trunc(try_cast(cell AS DOUBLE))::BIGINT AS whole FROM o""",
    "card_facets": """WITH l AS (SELECT 'tag' AS facet, unnest([o_orderpriority, o_orderstatus]) AS value FROM orders UNION SELECT 'class', n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey) SELECT facet, string_agg(value, '|' ORDER BY value) AS values FROM l WHERE value IS NOT NULL GROUP BY facet""",
}
