"""Windows of sensor series: power model, baseline, anomaly, best window, metrics, class scores, tags and cards.

Every step is one row per reading, dataset or window, partitioned by dataset; column names are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.ordered import numbered
from fathom.staging import staged

#: Readings of a chunk of a long series.
CHUNK = 100_000


@dataclass(frozen=True)
class Sensors:
    """Names of the columns that play each part. features are those of the row anomaly."""

    dataset: str = "dataset_id"
    pos: str = "id"
    time: str = "ts"
    split: str = "train_test"
    status: str = "status_type_id"
    wind: str = "wind"
    wind_std: str = "wind_std"
    wind_max: str = "wind_max"
    power: str = "power"
    power_std: str = "power_std"
    rotor: str = "rotor"
    gen: str = "gen"
    pitch: str = "pitch"
    wind_dir: str = "wind_dir"
    nacelle_dir: str = "nacelle_dir"
    temps: tuple[str, ...] = ("temp_1", "temp_2", "temp_3", "temp_4")
    features: tuple[str, ...] = (
        "wind", "wind_std", "wind_max", "wind_4", "power", "power_std", "rotor", "rotor_std", "gen", "gen_std", "pitch", "pitch_std", "temp_1", "temp_2", "temp_3", "temp_4",
    )


# Classes in order, status codes and texts, tags in order, and the weights in class_scores().
CLASSES = ("VG;MT", "LE;ER", "LR;DA", "LE;CR", "SF;PO")
NORMAL_STATUS = (0, 2)
STATUS_LEGEND = {
    "0": "Normal Operation - The turbine is in normal power production mode",
    "1": "Derated Operation - Derated power generation with a power restriction",
    "2": "Idling - Asset is idling and waits to operate again",
    "3": "Service - Asset is in service mode / service team is at the site",
    "4": "Downtime - Asset is down due a fault or other reasons",
    "5": "Other - Other operational states",
}
SUMMARY_ASK = "Summarize this 6h SCADA window in 3-4 sentences. Focus on operational patterns and anomalies. Do not diagnose faults. Stats: "
SUMMARY_STATS = (
    "wind_speed_mean", "wind_speed_std", "wind_speed_max", "power_mean", "power_std", "rotor_rpm_std", "generator_rpm_std", "pitch_mean", "yaw_misalignment_mean", "power_residual_mean", "temp_mean",
)
STATS = (
    "wind_speed_mean", "wind_speed_std", "wind_speed_max", "power_mean", "power_std", "rotor_rpm_mean", "rotor_rpm_std", "generator_rpm_mean", "generator_rpm_std", "pitch_mean", "pitch_std",
    "yaw_misalignment_mean", "yaw_misalignment_std", "temp_mean",
)
TAGS = (
    ("high_wind", "z_wind_speed_mean > 1.5"),
    ("high_wind_variability", "z_wind_speed_std > 1.5"),
    ("yaw_misalignment", "z_yaw_misalignment_mean > 1.5"),
    ("power_deficit", "z_power_residual_mean < -1.0"),
    ("power_variability", "z_power_std > 1.5"),
    ("rpm_instability", "z_rotor_rpm_std > 1.5 or z_generator_rpm_std > 1.5"),
    ("elevated_temps", "z_temp_mean > 1.5"),
    ("derated_or_downtime", "z_status_non_normal_ratio > 1.5"),
)


def number(c: Column) -> Column:
    """A double, null where the cell is no number or NaN."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(c: Column) -> Column:
    """An integer; decimals are cut, what is no number is null."""
    return F.coalesce(c.try_cast("int"), number(c).cast("int"))


def angle_diff(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def row_mean(columns: list[Column]) -> Column:
    """The mean of the columns that are not null."""
    total = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) for c in columns])
    n = reduce(lambda x, y: x + y, [c.isNotNull().cast("int") for c in columns])
    return total / F.nullif(n, F.lit(0))


def rounded(c: Column, digits: int) -> Column:
    """c rounded as arithmetic on doubles does it: halves of c times ten to the digits away from zero. Zero keeps its sign."""
    return F.signum(c) * F.round(F.abs(c * 10.0**digits)) / 10.0**digits


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std.isNull() | (std == 0), 0.0).otherwise((value - mean) / std)


def power_model(rows: DataFrame, s: Sensors = Sensors()) -> DataFrame:
    """dataset, slope, intercept: least squares of power on wind. With fewer than two pairs, or one wind speed only, the
    slope is 0 and the intercept the mean power of the pairs (0 if there is none)."""
    both = F.col(s.wind).isNotNull() & F.col(s.power).isNotNull()
    slope, intercept = F.regr_slope(s.power, s.wind), F.regr_intercept(s.power, s.wind)
    fit = rows.groupBy(s.dataset).agg(slope.alias("slope"), intercept.alias("intercept"), F.avg(F.when(both, F.col(s.power))).alias("flat"))
    return fit.select(s.dataset, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce(F.when(F.col("slope").isNotNull(), F.col("intercept")), "flat", F.lit(0.0)).alias("intercept"))


def residual(s: Sensors = Sensors()) -> Column:
    """Of rows joined with their model."""
    expected = F.col("slope") * F.col(s.wind) + F.col("intercept")
    return (F.col(s.power) - expected) / F.greatest(F.abs(expected), F.lit(1.0))


def _derived(rows: DataFrame, model: DataFrame, s: Sensors) -> DataFrame:
    joined = rows.join(model, s.dataset)
    return joined.withColumns({"_residual": residual(s), "_yaw": angle_diff(F.col(s.wind_dir), F.col(s.nacelle_dir)), "_temp": row_mean([F.col(t) for t in s.temps])})


def _odd_share(s: Sensors) -> Column:
    """Share of status codes that are not normal; nulls do not count, 0 if there are none."""
    n = F.count(s.status)
    return F.coalesce(F.count_if(~F.col(s.status).isin(list(NORMAL_STATUS))) / F.nullif(n, F.lit(0)), F.lit(0.0))


def baseline(rows: DataFrame, model: DataFrame, s: Sensors = Sensors()) -> DataFrame:
    """One row per dataset: mean_/std_ of the features (a std of 0 or null counts as 1), and b_ columns for the z-scores,
    whose std of 0 counts as 1 while null stays. The residuals' std is that of the population."""
    nonzero = lambda c: F.when(c == 0, 1.0).otherwise(c)
    aggs = []
    for f in s.features:
        aggs += [F.avg(f).alias(f"mean_{f}"), F.coalesce(nonzero(F.stddev_samp(f)), F.lit(1.0)).alias(f"std_{f}")]
    for name, column in (("wind", s.wind), ("power", s.power), ("pitch", s.pitch), ("power_std", s.power_std), ("wind_std", s.wind_std), ("yaw", "_yaw"), ("temp", "_temp")):
        aggs += [F.avg(column).alias(f"b_{name}_mean"), nonzero(F.stddev_samp(column)).alias(f"b_{name}_std")]
    aggs += [nonzero(F.stddev_samp(s.rotor)).alias("b_rotor_std"), nonzero(F.stddev_samp(s.gen)).alias("b_gen_std")]
    aggs += [F.avg("_residual").alias("b_residual_mean"), nonzero(F.stddev_pop("_residual")).alias("b_residual_std"), _odd_share(s).alias("b_status_ratio"), F.count("*").alias("b_rows")]
    return _derived(rows, model, s).groupBy(s.dataset).agg(*aggs)


def candidates(rows: DataFrame, events: DataFrame | None = None, n: int = 36, s: Sensors = Sensors()) -> DataFrame:
    """Prediction rows; of those, only rows of the event (dataset, first_id, last_id) if they are at least n."""
    predicted = rows.where(F.col(s.split) == "prediction")
    if events is None:
        return predicted
    inside = F.col(s.pos).between(F.col("first_id"), F.col("last_id"))
    marked = predicted.join(events, s.dataset, "left").withColumn("_inside", F.coalesce(inside, F.lit(False)))
    enough = F.count_if("_inside").over(Window.partitionBy(s.dataset)) >= n
    return marked.withColumn("_enough", enough).where(F.col("_inside") | ~F.col("_enough")).select(rows.columns)


def row_anomaly(rows: DataFrame, base: DataFrame, s: Sensors = Sensors()) -> DataFrame:
    """rows with anomaly: the mean over all features of their distance from the mean in stds; nulls count as 0."""
    parts = [F.coalesce(F.abs((F.col(f) - F.col(f"mean_{f}")) / F.col(f"std_{f}")), F.lit(0.0)) for f in s.features]
    joined = rows.join(base.select(s.dataset, *(f"{k}_{f}" for f in s.features for k in ("mean", "std"))), s.dataset)
    return joined.withColumn("anomaly", reduce(lambda a, b: a + b, parts) / len(parts)).select(*rows.columns, "anomaly")


def rolling(rows: DataFrame, n: int = 36, s: Sensors = Sensors(), column: str = "anomaly") -> DataFrame:
    """rows with roll, the mean of the last n readings; null until there are n."""
    w = Window.partitionBy(s.dataset).orderBy(s.pos).rowsBetween(-(n - 1), 0)
    return rows.withColumn("roll", F.when(F.count(F.lit(1)).over(w) == n, F.avg(column).over(w)))


def chunked(rows: DataFrame, n: int = 36, s: Sensors = Sensors(), size: int = CHUNK) -> DataFrame:
    """rows with _nth (their number in the order of dataset and position), _chunk and _halo: chunks of size rows, each with the
    n - 1 rows before it once more (_halo), so that every window of n rows lies in one chunk, however long a series is."""
    size = max(size, n)
    placed = numbered(rows, [s.dataset, s.pos], "_nth")
    own = F.floor(F.col("_nth") / size).cast("long")
    chunks = F.when(F.col("_nth") % size >= size - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))
    return placed.select("*", F.posexplode(chunks).alias("_copy", "_chunk")).withColumn("_halo", F.col("_copy") == 1).drop("_copy")


def rolling_chunked(rows: DataFrame, n: int = 36, s: Sensors = Sensors(), column: str = "anomaly", size: int = CHUNK) -> DataFrame:
    """What rolling() gives, with the number of each row as _nth; a series is cut into chunks that go to different tasks."""
    w = Window.partitionBy("_chunk", s.dataset).orderBy("_nth").rowsBetween(-(n - 1), 0)
    rolled = chunked(rows, n, s, size).withColumn("roll", F.when(F.count(F.lit(1)).over(w) == n, F.avg(column).over(w)))
    return rolled.where(~F.col("_halo")).select(*rows.columns, "_nth", "roll")


def best_window_chunked(rows: DataFrame, n: int = 36, calm: bool = False, s: Sensors = Sensors(), size: int = CHUNK) -> DataFrame:
    """What best_window() gives. The best end is found in each chunk before the shuffle, and the window's rows are joined by
    their numbers, so no task holds a series."""
    placed = staged(rolling_chunked(rows, n, s, size=size), "rolled")
    score = F.round("roll", 9)
    key = F.struct((-score if calm else score).alias("score"), (-F.col("_nth")).alias("nth"), F.col("roll").alias("roll"))
    best = placed.where("roll is not null").groupBy(s.dataset).agg(F.max(key).alias("_best"))
    wanted = best.select(F.col("_best.roll").alias("window_score"), F.explode(F.sequence(-F.col("_best.nth") - (n - 1), -F.col("_best.nth"))).alias("_nth"))
    return placed.join(wanted, "_nth").select(*rows.columns, "window_score")


def best_window(rows: DataFrame, n: int = 36, calm: bool = False, s: Sensors = Sensors()) -> DataFrame:
    """The n rows of each dataset that end where roll is greatest (least if calm), the first of equals, with roll of that
    end as window_score. Datasets with fewer than n rows have none. rows must have anomaly."""
    w = Window.partitionBy(s.dataset).orderBy(s.pos)
    placed = rolling(rows, n, s).withColumn("_nth", F.row_number().over(w))
    score = F.round("roll", 9)
    key = F.struct((-score if calm else score).alias("score"), (-F.col("_nth")).alias("nth"), F.col("roll").alias("roll"))
    best = placed.where("roll is not null").groupBy(s.dataset).agg(F.max(key).alias("_best"))
    joined = placed.join(best, s.dataset).where((F.col("_nth") <= -F.col("_best.nth")) & (F.col("_nth") > -F.col("_best.nth") - n))
    return joined.select(*rows.columns, F.col("_best.roll").alias("window_score"))


def window_metrics(window: DataFrame, base: DataFrame, model: DataFrame, s: Sensors = Sensors(), digits: int = 4) -> DataFrame:
    """One row per dataset: bounds, 14 stats, residual mean and std, status share and counts, and ten z-scores. z-scores are
    of the rounded stats, but for those of the residual and the status share."""
    r = lambda c: rounded(c, digits)
    pair = lambda name, column: [r(F.avg(column)).alias(f"{name}_mean"), r(F.stddev_samp(column)).alias(f"{name}_std")]
    rows = _derived(window, model, s)
    stats = [*pair("wind_speed", s.wind), r(F.max(s.wind_max)).alias("wind_speed_max"), *pair("power", s.power), *pair("rotor_rpm", s.rotor), *pair("generator_rpm", s.gen), *pair("pitch", s.pitch)]
    stats += [*pair("yaw_misalignment", "_yaw"), r(F.avg("_temp")).alias("temp_mean")]
    codes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n"))))
    counts = window.where(F.col(s.status).isNotNull()).groupBy(s.dataset, F.col(s.status).cast("int").cast("string").alias("code")).agg(F.count("*").alias("n"))
    counts = counts.groupBy(s.dataset).agg(codes.alias("status_counts"))
    ends = [F.min_by(s.time, s.pos).alias("start_time"), F.max_by(s.time, s.pos).alias("end_time"), F.min(s.pos).alias("start_id"), F.max(s.pos).alias("end_id"), F.count("*").alias("row_count")]
    found = rows.groupBy(s.dataset).agg(*ends, *stats, F.avg("_residual").alias("_rm"), F.stddev_pop("_residual").alias("_rs"), _odd_share(s).alias("_odd"))
    j = found.join(counts, s.dataset, "left").join(base.select(s.dataset, *(c for c in base.columns if c.startswith("b_"))), s.dataset)
    c = F.col
    p = c("b_status_ratio")
    spread = F.greatest(F.sqrt(p * (1 - p) / F.greatest(c("row_count"), F.lit(1))), F.lit(0.05))
    z = {
        "power_residual_mean": z_score(c("_rm"), c("b_residual_mean"), c("b_residual_std")),
        "wind_speed_mean": z_score(c("wind_speed_mean"), c("b_wind_mean"), c("b_wind_std")),
        "wind_speed_std": z_score(c("wind_speed_std"), c("b_wind_std_mean"), c("b_wind_std_std")),
        "yaw_misalignment_mean": z_score(c("yaw_misalignment_mean"), c("b_yaw_mean"), c("b_yaw_std")),
        "pitch_mean": z_score(c("pitch_mean"), c("b_pitch_mean"), c("b_pitch_std")),
        "rotor_rpm_std": z_score(c("rotor_rpm_std"), F.lit(0.0), c("b_rotor_std")),
        "generator_rpm_std": z_score(c("generator_rpm_std"), F.lit(0.0), c("b_gen_std")),
        "power_std": z_score(c("power_std"), c("b_power_std_mean"), c("b_power_std_std")),
        "temp_mean": z_score(c("temp_mean"), c("b_temp_mean"), c("b_temp_std")),
        "status_non_normal_ratio": (c("_odd") - p) / spread,
    }
    kept = [s.dataset, "start_time", "end_time", "start_id", "end_id", "row_count", *STATS]
    derived = [r(c("_rm")).alias("power_residual_mean"), r(c("_rs")).alias("power_residual_std"), r(c("_odd")).alias("status_non_normal_ratio"), "status_counts"]
    return j.select(*kept, *derived, *(v.alias(f"z_{k}") for k, v in z.items()))


def class_scores(metrics: DataFrame) -> DataFrame:
    """metrics with scores, a map of the five classes' hand-weighted sums."""
    up = lambda name: F.greatest(F.col(f"z_{name}"), F.lit(0.0))
    r, status = F.col("z_power_residual_mean"), F.col("z_status_non_normal_ratio")
    mild, strong = F.greatest(F.lit(0.0), 1.0 - F.abs(r + 0.5)), F.greatest(-r, F.lit(0.0))
    forms = (
        mild + 0.3 * up("pitch_mean") - 0.2 * F.abs(status),
        strong + 0.5 * up("pitch_mean") + 0.3 * up("power_std"),
        0.5 * up("wind_speed_mean") + 0.7 * up("wind_speed_std") + 0.6 * up("yaw_misalignment_mean") + 0.4 * up("status_non_normal_ratio"),
        0.6 * up("rotor_rpm_std") + 0.6 * up("generator_rpm_std") + 0.5 * up("temp_mean") + 0.3 * up("status_non_normal_ratio"),
        0.9 * mild - 0.2 * F.greatest(F.abs(F.col("z_pitch_mean")) - 1.0, F.lit(0.0)) - 0.2 * up("status_non_normal_ratio"),
    )
    return metrics.withColumn("scores", F.create_map(*(x for name, f in zip(CLASSES, forms) for x in (F.lit(name), f))))


def tags(metrics: DataFrame) -> DataFrame:
    """metrics with tags, those whose rule holds, in order."""
    named = F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in TAGS))
    return metrics.withColumn("tags", F.array_compact(named))


def time_slice(rows: DataFrame, hours: int | Column, s: Sensors = Sensors()) -> DataFrame:
    """Readings of each dataset in the hours up to its last row, both ends included; readings without a time drop out."""
    last = rows.groupBy(s.dataset).agg(F.max_by(s.time, s.pos).alias("_end"))
    joined = rows.join(last, s.dataset)
    return joined.where(F.col(s.time).between(F.col("_end") - F.make_interval(hours=F.lit(hours)), F.col("_end"))).select(rows.columns)


def select_windows(scored: DataFrame, per_class: int = 2, s: Sensors = Sensors()) -> DataFrame:
    """class_no, nth, dataset, end_id: each class in order takes its best-scored windows that no earlier class took; if
    these do not suffice it takes windows again, and then goes through them in turn.

    Classes before it can take no more than four times per_class of a class's best, so five times per_class windows of
    each class are all that the choice can depend on. These few are collected and chosen among in order.
    """
    keys, need = [s.dataset, "end_id"], len(CLASSES) * per_class
    rows = scored.select(*keys, F.explode("scores").alias("name", "score")).withColumn("score", F.round("score", 9))
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), *keys))).where(F.col("_n") <= need)
    by_class: dict[str, list[tuple]] = {}
    for r in sorted(best.collect(), key=lambda r: r["_n"]):
        by_class.setdefault(r["name"], []).append((r[s.dataset], r["end_id"]))
    taken, picks = set(), []
    for number_, name in enumerate(CLASSES):
        ranked = by_class.get(name, [])
        order = [k for k in ranked if k not in taken] + [k for k in ranked if k in taken]
        for nth in range(per_class if order else 0):
            picks.append((number_, nth + 1, *order[nth % len(order)]))
        taken |= {p[2:] for p in picks}
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}
    return scored.sparkSession.createDataFrame(picks, f"class_no int, nth int, {s.dataset} {kinds[s.dataset]}, end_id {kinds['end_id']}")


def select_calm(windows: DataFrame, count: int = 1, s: Sensors = Sensors(), taken: DataFrame | None = None) -> DataFrame:
    """nth, dataset, end_id of the calmest windows (window_score ascending), those that classes have taken (dataset,
    end_id) last; if there are fewer than count, all are gone through again in the order of their scores."""
    keys = [s.dataset, "end_id"]
    rows = windows.select(*keys, F.round("window_score", 9).alias("score")).distinct()
    if taken is None:
        rows = rows.withColumn("_taken", F.lit(0))
    else:
        rows = rows.join(taken.select(*keys).distinct().withColumn("_taken", F.lit(1)), keys, "left").fillna(0, ["_taken"])
    best = rows.orderBy("_taken", "score", *keys).limit(count)  # count rows at most, so the windows are small
    ranked = best.withColumn("_n", F.row_number().over(Window.orderBy("_taken", "score", *keys))).withColumn("_calm", F.row_number().over(Window.orderBy("score", *keys)))
    size = F.count("*").over(Window.partitionBy()).cast("int")
    again = F.filter(F.sequence(F.col("_calm"), F.col("_size") + count, F.col("_size")), lambda k: (k > F.col("_size")) & (k <= count))
    return ranked.withColumn("_size", size).select(F.explode(F.concat(F.array("_n"), again)).alias("nth"), *keys)


def window_ids(picked: DataFrame, s: Sensors = Sensors()) -> DataFrame:
    """picked with window_id; later picks of one window get -1, -2 and so on."""
    base = F.format_string("WF-A-%s-%s", F.col(s.dataset).cast("string"), F.col("end_id").cast("string"))
    again = F.row_number().over(Window.partitionBy(s.dataset, "end_id").orderBy("class_no", "nth")) - 1
    return picked.withColumn("_again", again).withColumn("window_id", F.when(F.col("_again") > 0, F.concat(base, F.lit("-"), F.col("_again").cast("string"))).otherwise(base)).drop("_again")


def cards(metrics: DataFrame, window_hours: int | Column = 6, baseline_hours: int | Column = 168, s: Sensors = Sensors(), window_id: Column | None = None, source: Column | None = None) -> DataFrame:
    """window_id and card, the nested record of each window as JSON. metrics must have tags. window_id and source are made
    of the dataset and the window's end unless they are given."""
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if window_id is None:
        window_id = F.format_string("WF-A-%s-%s", F.col(s.dataset).cast("string"), F.col("end_id").cast("string"))
    if source is None:
        source = F.struct(F.col(s.dataset).alias("dataset_id"), time("end_time").alias("window_end"))
    legend = F.create_map(*(F.lit(x) for pair in STATUS_LEGEND.items() for x in pair))
    card = F.struct(
        window_id.alias("window_id"),
        source.alias("source"),
        F.struct(
            time("end_time").alias("end_time"), time("start_time").alias("start_time"), F.col("row_count"), F.lit(baseline_hours).alias("baseline_hours"), F.lit(window_hours).alias("window_hours")
        ).alias("window"),
        F.struct(*STATS).alias("stats"),
        F.struct("power_residual_mean", "power_residual_std", F.col("status_counts").alias("status_10min_interval_counts"), legend.alias("status_legend")).alias("derived"),
        F.col("tags"),
    )
    return metrics.select(window_id.alias("window_id"), F.to_json(card).alias("card"))


def card_facets(listed: DataFrame) -> DataFrame:
    """facet, values: the distinct sorted tags and class labels of listed cards (tags, class_label)."""
    rows = listed.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value")).unionByName(listed.select(F.lit("class").alias("facet"), F.col("class_label").alias("value")))
    return rows.where("value is not null").groupBy("facet").agg(F.array_sort(F.collect_set("value")).alias("values"))


def summary_prompt(metrics: DataFrame, s: Sensors = Sensors()) -> DataFrame:
    """dataset, prompt: what a language model would be asked to summarise; no call is made here. metrics must have tags."""
    legend = F.create_map(*(F.lit(x) for pair in STATUS_LEGEND.items() for x in pair))
    label = lambda code: F.coalesce(F.try_element_at(legend, code), F.concat(F.lit("Status "), code))
    counts = F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["value"].cast("string"), F.lit(" intervals: "), label(e["key"])))
    status = F.coalesce(F.nullif(F.array_join(counts, "; "), F.lit("")), F.lit("no status data"))
    stats = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("nan"))) for n in SUMMARY_STATS))
    named = F.coalesce(F.nullif(F.array_join("tags", ", "), F.lit("")), F.lit("none"))
    return metrics.select(s.dataset, F.concat(F.lit(SUMMARY_ASK), stats, F.lit(". Turbine status (10-min intervals): "), status, F.lit(". Tags: "), named, F.lit(".")).alias("prompt"))
