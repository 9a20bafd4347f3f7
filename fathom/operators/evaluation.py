"""Scores of rankings and of label sets; every query or case at once, by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.retrieval import SERVICE
from fathom.staging import sized, staged

#: Weights of kinds are those of ranking.
KIND_WEIGHTS = SERVICE.boosts
# Labels in their order, the abstaining label.
LABEL_ORDER = ("VG;MT", "LE;ER", "LR;DA", "LE;CR", "SF;PO", "No Damage", "Invalid_Image")
UNCERTAIN = "Uncertain"
MODES = ("strict", "abstain_penalize", "abstain_skip")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def gold_groups(asks: DataFrame, gold: DataFrame, query: str = "query_id", group: str = "label") -> tuple[DataFrame, DataFrame]:
    """of (query, group) and gold, where queries share gold by their group: asks has query and group, gold has group and its
    items. Both go to the measures as they are, so gold is never repeated for each query of a group.

    Groups become arrays: a query that comes with several groups has an array of its own, whose gold is theirs together.
    """
    of = asks.where(F.col(group).isNotNull()).groupBy(query).agg(F.array_sort(F.collect_set(group)).alias("_of"))
    sets = sized(staged(of.select("_of").distinct().select("_of", F.explode("_of").alias(group)), "groups"))
    met = gold.join(sets, group)
    return of.withColumnRenamed("_of", group), met.drop(group).withColumnRenamed("_of", group)


def _asked(hits: DataFrame, gold: DataFrame, query: str, of: DataFrame | None, group: str) -> tuple[str, DataFrame, DataFrame]:
    """The key of gold, hits with that key, and the queries that have gold, with it."""
    if of is None:
        return query, hits, gold.select(query).distinct()
    return group, hits.join(of, query), of.join(gold.select(group).distinct(), group)


def ir_metrics(hits: DataFrame, gold: DataFrame, query: str = "query_id", item: str = "item", of: DataFrame | None = None, group: str = "label") -> DataFrame:
    """query, n_hits, recall, precision, hit, mrr, ndcg, weighted_recall for each query of gold.

    hits has query, item, rank; gold has query, item and, for weights, kind. Both are taken as sets in order of the best
    rank: an item that comes twice counts at its first place, and places are counted without repeats. With of, gold has
    the group of gold_groups() instead of query; it is counted by group and meets hits alone.
    """
    weighed = "kind" in gold.columns
    kinds = F.create_map(*(F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair))
    weight = F.coalesce(F.try_element_at(kinds, F.col("kind")), F.lit(1.0)) if weighed else F.lit(1.0)
    key = query if of is None else group
    wanted = gold.groupBy(key, item).agg(F.max(weight).alias("w"))
    first = hits.groupBy(query, item).agg(F.min("rank").alias("rank"))
    ordered = first.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", item))).alias("list"))
    placed = ordered.select(query, F.size("list").alias("n_got"), F.posexplode("list").alias("pos", "x")).select(query, "n_got", (F.col("pos") + 1).alias("place"), F.col(f"x.{item}").alias(item))
    own = placed if of is None else placed.join(of, query)
    met = own.join(wanted, [key, item], "left").withColumn("_hit", F.when(F.col("w").isNotNull(), F.col("place")))
    found = met.groupBy(query).agg(F.first("n_got").alias("n_got"), F.count("_hit").alias("n_hits"), F.min("_hit").alias("best"), F.sum(1 / F.log2(F.col("_hit") + 1)).alias("dcg"), F.sum("w").alias("w_hit"))
    counts = wanted.groupBy(key).agg(F.count("*").alias("n_gold"), F.sum("w").alias("w_all"))
    j = (counts if of is None else of.join(counts, group)).join(found, query, "left").fillna(0, ["n_got", "n_hits"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_gold", "n_got"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1))
    c = F.col
    return j.select(
        query, "n_hits", _ratio(c("n_hits"), c("n_gold")).alias("recall"), _ratio(c("n_hits"), c("n_got")).alias("precision"), F.when(c("n_hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1 / c("best"), F.lit(0.0)).alias("mrr"), F.coalesce(c("dcg") / ideal, F.lit(0.0)).alias("ndcg"), _ratio(F.coalesce("w_hit", F.lit(0.0)), c("w_all")).alias("weighted_recall"),
    )


def section_keys(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """rows (query, source, section and, of hits, rank) with the key source::section as item; rows with neither drop out."""
    src, sec = F.coalesce("source", F.lit("")), F.coalesce("section", F.lit(""))
    return rows.where((src != "") | (sec != "")).withColumn("item", F.concat(src, F.lit("::"), sec)).drop("source", "section")


def isolated(cases: DataFrame, metrics: DataFrame, query: str = "query_id") -> DataFrame:
    """Every case (query, class_label) with its metrics and error: cases without a query text or without gold, or for which
    there are no metrics, say why and have none; the others go on."""
    why = F.when(F.coalesce(F.trim("query_text"), F.lit("")) == "", "no query text").when(F.coalesce(F.size("gold"), F.lit(0)) == 0, "no gold")
    joined = cases.withColumn("_why", why).join(metrics.withColumn("_met", F.lit(True)), query, "left")
    error = F.coalesce("_why", F.when(F.col("_met").isNull(), F.lit("no metrics")))
    kept = [F.when(error.isNull(), F.col(c)).alias(c) for c in metrics.columns if c != query]
    return joined.select(query, "class_label", error.alias("error"), *kept)


def page_keys(hits: DataFrame, gold: DataFrame, tolerance: int = 1, query: str = "query_id", of: DataFrame | None = None, group: str = "label") -> tuple[DataFrame, DataFrame]:
    """hits and gold as page keys (query, item, rank): a hit stands for the first gold page (by gold_no) of its source that
    is within tolerance, hits without one drop out. hits has query, source, page, rank; gold has query, source, page, gold_no.
    With of, gold has the group of gold_groups() instead of query, and keeps it."""
    name = lambda page: F.concat_ws("::p", "source", page.cast("string"))
    key, own, _ = _asked(hits, gold, query, of, group)
    g = gold.where("source is not null and page is not null")
    reach = F.explode(F.sequence(F.col("page") - tolerance, F.col("page") + tolerance))  # so that pages meet by equality
    near = g.select(key, "source", F.col("page").alias("gp"), "gold_no", reach.alias("page")).groupBy(key, "source", "page").agg(F.min_by("gp", "gold_no").alias("gp"))
    matched = own.join(near, [key, "source", "page"]).select(query, "source", "page", "rank", "gp").distinct()
    return matched.select(query, name(F.col("gp")).alias("item"), "rank"), g.select(key, name(F.col("page")).alias("item"))


def simple_metrics(hits: DataFrame, gold: DataFrame, k: int, query: str = "query_id", item: str = "item", of: DataFrame | None = None, group: str = "label") -> DataFrame:
    """One row: mean precision at k (of k, not of what was found) and mean reciprocal rank over the queries of gold. With
    of, gold has the group of gold_groups() instead of query."""
    best = hits.where(F.col("rank") <= k).groupBy(query, item).agg(F.min("rank").alias("rank"))
    key, own, asked = _asked(best, gold, query, of, group)
    met = own.join(gold.select(key, item).distinct(), [key, item]).groupBy(query).agg(F.count("rank").alias("n"), F.min("rank").alias("first"))
    per = asked.join(met, query, "left")
    return per.agg(F.avg(F.coalesce("n", F.lit(0)) / k).alias("precision_at_k"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def mean_metrics(metrics: DataFrame, names: list[str], by: str = "class_label") -> DataFrame:
    """Means of the valid cases (without error, if there is such a column), over all (by null) and per class."""
    valid = metrics.where("error is null") if "error" in metrics.columns else metrics
    sets = valid.groupingSets([[], [by]], by)
    return sets.agg(F.grouping(by).alias("is_all"), F.count("*").alias("n"), *(F.avg(n).alias(n) for n in names))


def one_label(label: Column) -> Column:
    """A single label as the array that label_set() takes; null and blank are no label."""
    return F.when(F.trim(label) != "", F.array(label)).otherwise(F.array().cast("array<string>"))


def label_set(labels: Column) -> Column:
    """Stripped non-empty labels as a sorted set; null is the empty set. For columns of single labels see one_label()."""
    trimmed = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def abstain(rows: DataFrame) -> DataFrame:
    """mode, id, gold, pred, skipped of every row in each of the three modes of treating the abstaining label. rows has id,
    gold_labels, pred_labels."""
    own = rows.select("id", label_set(F.col("gold_labels")).alias("gold"), label_set(F.col("pred_labels")).alias("raw"), F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    sure = F.array_remove("raw", UNCERTAIN)
    skipped = (F.col("mode") == "abstain_skip") & F.array_contains("raw", UNCERTAIN) & (F.size(sure) == 0)
    return own.select("mode", "id", "gold", F.when(F.col("mode") == "strict", F.col("raw")).otherwise(sure).alias("pred"), skipped.alias("skipped"))


def label_counts(prepared: DataFrame) -> DataFrame:
    """mode, label, tp, fp, fn, tn, precision, recall, f1 over rows that are not skipped. Each row gives only its own labels;
    tn is what is left of the mode's rows, so nothing is crossed."""
    kept = prepared.where(~F.col("skipped"))
    totals = kept.groupBy("mode").agg(F.count("*").alias("rows"))
    marks = kept.select("mode", "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("label"))
    in_gold, in_pred = F.array_contains("gold", F.col("label")), F.array_contains("pred", F.col("label"))
    counts = marks.groupBy("mode", "label").agg(F.count_if(in_gold & in_pred).alias("tp"), F.count_if(~in_gold & in_pred).alias("fp"), F.count_if(in_gold & ~in_pred).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = counts.join(totals, "mode").withColumn("tn", F.col("rows") - tp - fp - fn).withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("rows")


def set_metrics(prepared: DataFrame) -> DataFrame:
    """mode, num_samples, skipped, coverage, exact, micro_precision, micro_recall, micro_f1, macro_f1."""
    per = label_counts(prepared).groupBy("mode").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"))
    rows = prepared.groupBy("mode").agg(
        F.count_if(~F.col("skipped")).alias("num_samples"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped") & (F.col("gold") == F.col("pred"))).alias("same")
    )
    j = rows.join(per, "mode", "left").fillna(0, ["tp", "fp", "fn", "macro_f1"])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return j.select(
        "mode", "num_samples", "skipped", _ratio(F.col("num_samples"), F.col("num_samples") + F.col("skipped")).alias("coverage"), _ratio(F.col("same"), F.col("num_samples")).alias("exact"),
        p.alias("micro_precision"), r.alias("micro_recall"), _ratio(2 * p * r, p + r).alias("micro_f1"), "macro_f1",
    )


def set_key(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, F.lit("<none>")).otherwise(F.array_join(labels, "|"))


def confusion_sets(prepared: DataFrame) -> DataFrame:
    """mode, gold, pred, n of whole label sets; pairs that do not occur have no row."""
    kept = prepared.where(~F.col("skipped"))
    return kept.groupBy("mode", set_key(F.col("gold")).alias("gold"), set_key(F.col("pred")).alias("pred")).agg(F.count("*").alias("n"))


def confusion_labels(prepared: DataFrame) -> DataFrame:
    """mode, gold, pred, n: every gold label of a row with every predicted one, <none> where nothing was predicted."""
    kept = prepared.where(~F.col("skipped")).select("mode", F.explode("gold").alias("gold"), "pred")
    pred = F.when(F.size("pred") == 0, F.array(F.lit("<none>"))).otherwise(F.col("pred"))
    return kept.select("mode", "gold", F.explode(pred).alias("pred")).groupBy("mode", "gold", "pred").agg(F.count("*").alias("n"))


def as_matrix(confusion: DataFrame, keys: list[str]) -> DataFrame:
    """One mode's confusion as a square table over keys, zeros where nothing occurs."""
    wide = confusion.groupBy("gold").pivot("pred", keys).agg(F.sum("n"))
    frame = confusion.sparkSession.createDataFrame([(k,) for k in keys], "gold string")
    return frame.join(wide, "gold", "left").fillna(0)


def label_order(label: Column) -> Column:
    """A key that sorts the known labels first, in their order, and others by name."""
    place = F.array_position(F.array(*map(F.lit, LABEL_ORDER)), label)
    return F.struct(F.when(place > 0, place).otherwise(F.lit(len(LABEL_ORDER) + 1)), label)


def pick_examples(examples: list[dict], most: int) -> list[dict]:
    """Few-shot examples: two without damage, one invalid, then damage by the number of categories while they use two
    categories at most, then any damage. Dozens of rows on the driver, chosen one after another."""
    of = lambda kind: [e for e in examples if e.get("example_type") == kind]
    kinds = lambda e: {f["category_name"] for f in e.get("findings") or [] if f.get("category_name")}
    chosen, used = of("no_damage")[:2] + of("invalid")[:1], set()
    damage = sorted(of("damage"), key=lambda e: len(kinds(e)))
    late = []
    for e in damage:
        if kinds(e) and len(used | kinds(e)) <= 2 and len(chosen) < most:
            chosen.append(e)
            used |= kinds(e)
        else:
            late.append(e)
    return (chosen + late)[:most]
