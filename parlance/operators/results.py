"""Results as tidy tables: categories, pooling, histograms, correlation, caching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlance.functions.text import python_bool

CATEGORY_FIELDS = ("model", "include_player_personalities")


def categories(campaigns: DataFrame, meta: DataFrame, fields: tuple[str, ...] = CATEGORY_FIELDS) -> DataFrame:
    """``campaign_id, category``: the metadata fields as ``name:value``, joined; ``human`` without metadata.

    A campaign counts as human if its metadata has no model; ``llm_other`` if none of the fields is set.
    """
    kinds = dict(meta.dtypes)
    parts = [F.concat(F.lit(f"{f}:"), python_bool(F.col(f)) if kinds[f] == "boolean" else F.col(f).cast("string")) for f in fields]
    label = F.concat_ws(", ", *parts)
    known = meta.where("model IS NOT NULL").select("campaign_id", F.when(label == "", "llm_other").otherwise(label).alias("category"))
    return campaigns.join(known, "campaign_id", "left").withColumn("category", F.coalesce("category", F.lit("human")))


def pool(values: DataFrame, category: DataFrame, value: str) -> DataFrame:
    """Pooled figures per category of a value per campaign; categories come human first, then by name."""
    joined = values.join(category, "campaign_id", "right")
    each = joined.groupBy("category").agg(
        F.count_distinct("campaign_id").alias("campaigns"), F.count(value).alias("values"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median")
    )
    return each.withColumn("position", F.row_number().over(W.orderBy(F.when(F.col("category") == "human", 0).otherwise(1), "category")))


def pool_characters(values: DataFrame, category: DataFrame) -> DataFrame:
    """Figures per category and metric, pooled over the characters' values ``(campaign_id, metric, value)`` of all its campaigns.

    Null and NaN values do not count; a category without values keeps a row for each metric.
    """
    kept = values.select("campaign_id", "metric", F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value"))
    each = kept.join(category, "campaign_id").groupBy("category", "metric").agg(
        F.count_distinct(F.when(F.col("value").isNotNull(), F.col("campaign_id"))).alias("campaigns"), F.count("value").alias("values"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"),
    )
    # Few categories and metrics.
    every = category.select("category").distinct().crossJoin(kept.select("metric").distinct())
    return every.join(each, ["category", "metric"], "left").na.fill(0, ["campaigns", "values"])


def histogram(values: DataFrame, value: Column, edges: int = 20, log: bool = False, group: list[str] | None = None) -> DataFrame:
    """Counts in ``edges - 1`` equal bins between the least and the largest value of all groups, the last one closed.

    Nulls and NaN are left out; with ``log`` the bins are equal in the logarithm and only positive values count.
    """
    group = group or []
    rows = values.select(*group, value.cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)" + (" AND x > 0" if log else ""))
    rows = rows.withColumn("y", F.log10("x")) if log else rows.withColumn("y", F.col("x"))
    limits = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    bins = edges - 1
    # One row of limits.
    placed = rows.crossJoin(F.broadcast(limits))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("y") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return placed.groupBy(*group, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlations(values: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs of columns over the rows where both are there, in one pass."""
    clean = values.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = clean.agg(*(F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))
    return one.select(F.explode(rows).alias("p")).select("p.*")


def compare_models(values: DataFrame, keys: list[str], model: str, value: str, models: list[str]) -> DataFrame:
    """One column per model with the mean of its values, side by side for the same keys; null where a model has none."""
    return values.groupBy(*keys).pivot(model, models).agg(F.round(F.avg(value), 6))


def panels(values: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Histograms of several columns over the same rows: ``panel, bin, n`` with ``bins`` equal bins each."""
    out = None
    for c in columns:
        one = histogram(values, F.col(c), bins + 1).select(F.lit(c).alias("panel"), "bin", "n")
        out = one if out is None else out.unionByName(one)
    return out


def tidy(values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A wide table as ``keys, metric, value`` rows."""
    return values.unpivot(keys, columns, "metric", "value")


def resolve_metric(series: DataFrame, summary: DataFrame, name: str) -> DataFrame:
    """Values of a metric: from the series if it has the name, else from the summary."""
    wanted = series.where(F.col("metric") == name).select("campaign_id", "value", F.lit(0).alias("_p"))
    wanted = wanted.unionByName(summary.where(F.col("metric") == name).select("campaign_id", "value", F.lit(1).alias("_p")))
    best = wanted.groupBy("campaign_id").agg(F.min("_p").alias("_p"))
    return wanted.join(best, ["campaign_id", "_p"], "left_semi").drop("_p")


def day_topics(rows: DataFrame, day: Column, topic: Column, topics: list[str]) -> DataFrame:
    """Counts per day and topic with zeros filled in; the topics are given, so the pivot needs no extra pass."""
    return rows.select(day.alias("day"), topic.alias("topic")).where("day IS NOT NULL").groupBy("day").pivot("topic", topics).count().na.fill(0)


def transitions(turns: DataFrame, column: str) -> DataFrame:
    """How often one value follows another from turn to turn."""
    after = turns.select("campaign_id", (F.col("turn_idx") - 1).alias("turn_idx"), F.col(column).alias("to"))
    return turns.select("campaign_id", "turn_idx", F.col(column).alias("from")).join(after, ["campaign_id", "turn_idx"]).groupBy("from", "to").agg(F.count("*").alias("n"))


def top_transitions(matrix: DataFrame, top: int = 3) -> DataFrame:
    """The part of a transition matrix between its ``top`` values with the largest row sums."""
    best = matrix.groupBy("from").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "from").limit(top).select("from")
    return matrix.join(best, "from", "left_semi").join(best.withColumnRenamed("from", "to"), "to", "left_semi").select("from", "to", "n")


def missing(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not cached."""
    return wanted.join(cached.select(*keys).distinct(), keys, "left_anti")


def merged(cached: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Cached and new results; new ones win."""
    return cached.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def fingerprint(metric: str, parameters: dict[str, object]) -> str:
    """Key of a cached result: the metric and all its parameters."""
    import hashlib
    import json

    return f"{metric}-{hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]}"


def save_results(results: DataFrame, folder: str, metric: str, parameters: dict[str, object]) -> str:
    """Write results under their fingerprint, partitioned by campaign prefix so that single campaigns can be replaced."""
    path = f"{folder}/{fingerprint(metric, parameters)}"
    results.write.mode("overwrite").parquet(path)
    return path
