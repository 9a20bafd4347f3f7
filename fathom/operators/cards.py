"""Window payloads and cards: one record per window, built from embedded readings, listed with their classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import timeseries as X
from fathom.sources import files

#: Fields of a payload's meta that cards do not show.
HIDDEN = ("event_id", "event_label", "event_description")


def window_payloads(rows: DataFrame, ends: DataFrame, columns: list[str], baseline_hours: int = 168, window_hours: int = 6, sep: str = ";", s: X.Sensors = X.Sensors()) -> DataFrame:
    """window_id, baseline_hours, window_hours, csv_sep, csv of each window: the readings of the baseline_hours up to its
    end, both ends included, as CSV text with a header. ends has window_id, the dataset and end_time."""
    time = F.date_format(s.time, "yyyy-MM-dd HH:mm:ss")
    cells = [F.coalesce(time if c == s.time else F.col(c).cast("string"), F.lit("")) for c in columns]
    near = rows.join(ends.select("window_id", s.dataset, "end_time"), s.dataset)
    near = near.where(F.col(s.time).between(F.col("end_time") - F.make_interval(hours=F.lit(baseline_hours)), F.col("end_time")))
    lines = near.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct(F.col(s.pos).alias("pos"), F.concat_ws(sep, *cells).alias("line")))).alias("l"))
    body = F.concat(F.lit(sep.join(columns) + "\n"), F.array_join("l.line", "\n"), F.lit("\n"))
    return lines.select("window_id", F.lit(baseline_hours).alias("baseline_hours"), F.lit(window_hours).alias("window_hours"), F.lit(sep).alias("csv_sep"), body.alias("csv"))


def payload_cards(payloads: DataFrame, time: str = "time_stamp", s: X.Sensors = X.Sensors(dataset="window_id", pos="nth", time="_time")) -> DataFrame:
    """window_id and card of payloads (window_id, csv, csv_sep, baseline_hours, window_hours, meta as a map of strings).

    Baseline and power model are of the payload's own readings in the baseline_hours up to its last row, which include
    the window. Payloads whose last time does not parse have no card.
    """
    sensors = list(dict.fromkeys([*s.features, s.wind, s.wind_std, s.wind_max, s.power, s.power_std, s.rotor, s.gen, s.pitch, s.wind_dir, s.nacelle_dir, *s.temps]))
    cells = files.embedded_csv(payloads, [time, s.status, *sensors])
    rows = cells.select("window_id", "nth", files.time_of(F.col(time)).alias(s.time), X.whole(F.col(s.status)).alias(s.status), *(X.number(F.col(c)).alias(c) for c in sensors))
    rows = rows.join(payloads.select("window_id", "baseline_hours", "window_hours"), "window_id")
    history, window = X.time_slice(rows, F.col("baseline_hours"), s), X.time_slice(rows, F.col("window_hours"), s)
    model = X.power_model(history, s)
    metrics = X.tags(X.window_metrics(window, X.baseline(history, model, s), model, s))
    shown = F.map_filter("meta", lambda k, v: ~k.isin(list(HIDDEN)))
    metrics = metrics.join(payloads.select("window_id", "baseline_hours", "window_hours", shown.alias("source")), "window_id")
    return X.cards(metrics, F.col("window_hours"), F.col("baseline_hours"), s, F.col("window_id"), F.col("source"))


def manifest(picked: DataFrame, meta: DataFrame) -> DataFrame:
    """window_id, file and meta of picked windows; meta has window_id and its fields."""
    fields = [c for c in meta.columns if c != "window_id"]
    return picked.select("window_id").join(meta, "window_id").select("window_id", F.concat("window_id", F.lit(".json")).alias("file"), F.struct(*fields).alias("meta"))


def by_class(picked: DataFrame) -> DataFrame:
    """class_no and window_ids, in the order in which a class took them."""
    rows = picked.groupBy("class_no").agg(F.array_sort(F.collect_list(F.struct("nth", "window_id"))).alias("w"))
    return rows.select("class_no", F.col("w.window_id").alias("window_ids"))


def listing(cards: DataFrame, classes: DataFrame) -> DataFrame:
    """id, class_code, window_start, window_end, tags, event_label, event_label_display, event_description of cards as
    files.cards() reads them. classes has class_code, window_id.

    A window without a class takes that of its base id, which lacks the last number. A missing end is that of the source,
    a missing start is window_hours before the end.
    """
    w, src, text = F.col("window"), F.col("source"), lambda c: F.coalesce(c, F.lit(""))
    several = F.size(F.split("window_id", "-")) > 4
    base = F.when(several, F.regexp_replace("window_id", "-[^-]*$", "")).otherwise(F.col("window_id"))
    end = F.coalesce(F.nullif(w["end_time"], F.lit("")), src["window_end"], F.lit(""))
    early = files.time_of(end) - F.make_interval(secs=3600 * w["window_hours"].cast("double"))
    start = F.coalesce(F.nullif(w["start_time"], F.lit("")), F.date_format(early, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    of = classes.groupBy("window_id").agg(F.max("class_code").alias("_class"))
    rows = cards.withColumn("_base", base).join(of, "window_id", "left")
    rows = rows.join(of.select(F.col("window_id").alias("_base"), F.col("_class").alias("_of_base")), "_base", "left")
    label = F.coalesce(src["event_label"], F.lit("normal"))
    return rows.select(
        F.col("window_id").alias("id"), F.coalesce(F.nullif("_class", F.lit("")), "_of_base", F.lit("")).alias("class_code"), start.alias("window_start"), end.alias("window_end"), "tags",
        label.alias("event_label"), F.when(label == "normal", "no recorded anomaly").otherwise(label).alias("event_label_display"),
        F.when(text(src["event_description"]) == "nan", "").otherwise(text(src["event_description"])).alias("event_description"),
    )
