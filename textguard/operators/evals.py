"""Evaluation: confusion metrics, areas, percentiles, threshold sweeps, probe recall and reports.

Curves work on counts per score of four digits, at most 10,001 rows whatever the input, so no window sorts all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 4


def over(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0."""
    return F.when(b > 0, F.round(a / b, digits)).otherwise(0.0)


def confusion(df: DataFrame, truth: Column, flagged: Column, *by: str) -> DataFrame:
    """Counts and rates of flagged rows against the truth, over all rows or by groups. Rows with a null on either side
    don't count."""
    d = df.withColumn("t_", truth).withColumn("f_", flagged).where("t_ is not null and f_ is not null")
    n = d.groupBy(*by).agg(F.count_if(F.expr("t_ and f_")).alias("tp"), F.count_if(F.expr("not t_ and not f_")).alias("tn"), F.count_if(F.expr("not t_ and f_")).alias("fp"), F.count_if(F.expr("t_ and not f_")).alias("fn"))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return n.withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "fpr": over(fp, fp + tn), "fnr": over(fn, fn + tp), "accuracy": over(tp + tn, tp + tn + fp + fn)})


def score_counts(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """(score, pos, neg) per score of four digits."""
    d = df.select(F.round(score, DIGITS).alias("score"), truth.alias("t_")).where("score is not null and t_ is not null")
    return d.groupBy("score").agg(F.count_if("t_").alias("pos"), F.count_if(F.expr("not t_")).alias("neg"))


def areas(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """(auc_roc, auc_pr): by mid-ranks, and the average precision; null if a class is missing."""
    c = score_counts(df, truth, score)
    down = Window.orderBy(F.desc("score"))  # at most 10,001 rows
    c = c.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down))
    total = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return total.select(F.when(both, F.round(F.col("wins") / (F.col("p") * F.col("n")), 6)).alias("auc_roc"), F.when(both, F.round(F.col("ap") / F.col("p"), 6)).alias("auc_pr"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean and linearly interpolated percentiles of times, which are rounded to tenths so that the exact percentile
    holds few distinct values."""
    v = F.round(value, 1)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), *[F.round(F.percentile(v, p), 4).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)])


def judge_metrics(df: DataFrame, truth: Column, verdict: str, latency_col: str) -> DataFrame:
    """Confusion of a judge's verdicts, errors (verdict ERROR or null) apart, with nearest-rank percentiles of its times."""
    bad = F.col(verdict).isNull() | (F.col(verdict) == "ERROR")
    d = df.withColumn("t_", truth).withColumn("v_", F.col(verdict)).withColumn("bad_", F.coalesce(bad, F.lit(True)))
    flagged = (F.col("v_") == "MALICIOUS") & ~F.col("bad_")
    ok = ~F.col("bad_")
    n = d.agg(
        F.count("*").alias("total"), F.count_if("bad_").alias("errors"), F.count_if(F.col("t_") & flagged).alias("tp"), F.count_if(~F.col("t_") & flagged).alias("fp"),
        F.count_if(F.col("t_") & ok & ~flagged).alias("fn"), F.count_if(~F.col("t_") & ok & ~flagged).alias("tn"),
        F.expr(f"percentile_disc(0.5) within group (order by round({latency_col}, 1))").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by round({latency_col}, 1))").alias("p95"),
    )
    return n.withColumn("fpr", over(F.col("fp"), F.col("fp") + F.col("tn"))).withColumn("fnr", over(F.col("fn"), F.col("fn") + F.col("tp")))


def examples(df: DataFrame, wrong: Column, order: str, n: int = 10) -> DataFrame:
    """The first n wrong rows, a report's feature."""
    return df.where(wrong).orderBy(order).limit(n)


def sweep(df: DataFrame, truth: Column, score: Column, steps: int = 99) -> DataFrame:
    """Per threshold k / 100: tpr, fpr, precision, f1 and Youden's J."""
    c = score_counts(df, truth, score)
    ks = df.sparkSession.range(1, steps + 1).select(F.col("id").alias("k"))
    hit = F.broadcast(ks).join(c, F.col("score") >= F.col("k") / 100, "left")  # 99 rows against at most 10,001
    n = hit.groupBy("k").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    total = c.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p_"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_"))
    d = n.join(F.broadcast(total), F.lit(True))  # one row
    tpr, fpr = F.col("tp") / F.col("p_"), F.col("fp") / F.col("n_")
    tpr, fpr = F.when(F.col("p_") > 0, tpr).otherwise(0.0), F.when(F.col("n_") > 0, fpr).otherwise(0.0)
    return d.select((F.col("k") / 100).alias("threshold"), F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"), over(F.col("tp"), F.col("tp") + F.col("fp"), 6).alias("precision"), over(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p_"), 6).alias("f1"), F.round(tpr - fpr, 6).alias("j"))


def best(swept: DataFrame, least_tpr: float = 0.95) -> DataFrame:
    """The threshold of the largest J (the lowest of equal ones), and that of the smallest fpr with tpr >= least_tpr."""
    j = F.max_by("threshold", F.struct("j", -F.col("threshold")))
    safe = F.min_by(F.when(F.col("tpr") >= least_tpr, F.col("threshold")), F.when(F.col("tpr") >= least_tpr, F.struct("fpr", F.col("threshold"))))
    return swept.agg(j.alias("best_j"), safe.alias("best_fpr"))


def detected(label: Column, rejected: Column | None = None) -> Column:
    """Whether a classifier's answer means an attack: rejected, or a label whose word is malicious or blocked, whatever
    signs stand around it."""
    word = F.upper(F.regexp_replace(label, "[^A-Za-z]", ""))
    yes = F.coalesce(word.isin("MALICIOUS", "BLOCKED"), F.lit(False))
    return yes if rejected is None else yes | F.coalesce(rejected, F.lit(False))


def probed(df: DataFrame, flagged: Column, attributed: str, expected: str = "technique_id") -> DataFrame:
    """Adds benign, flagged and attributed (whether the expected technique is among those found)."""
    return df.withColumn("benign", F.endswith(expected, F.lit("_benign"))).withColumn("flagged", flagged).withColumn("attributed", F.coalesce(F.array_contains(attributed, F.col(expected)), F.lit(False)))


def recall_groups(rows: DataFrame) -> DataFrame:
    """(dimension, value, total, detected, attributed, missed, recall, attribution, effective_difficulty) of attacks, over all
    and by technique, difficulty and evasion: one pass by grouping sets."""
    kinds = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in (("all", F.lit("")), ("technique", F.col("technique_id")), ("difficulty", F.col("difficulty")), ("evasion", F.col("evasion")))])
    n = rows.where("not benign").select(F.inline(kinds), "flagged", "attributed").groupBy("dimension", "value").agg(F.count("*").alias("total"), F.count_if("flagged").alias("detected"), F.count_if("attributed").alias("attributed"))
    recall = over(F.col("detected"), F.col("total"))
    return n.withColumns({"missed": F.col("total") - F.col("detected"), "recall": recall, "attribution": over(F.col("attributed"), F.col("total")), "effective_difficulty": F.round(1 - recall, 4)})


def attribution(rows: DataFrame, found: str, expected: str = "technique_id") -> DataFrame:
    """(expected, found, n): which techniques are found for which; `_none` if none is."""
    each = rows.select(F.col(expected).alias("expected"), F.explode_outer(found).alias("found"))
    return each.groupBy("expected", F.coalesce("found", F.lit("_none")).alias("found")).agg(F.count("*").alias("n"))


def by_tag(groups: DataFrame, tags: DataFrame, namespace: str = "") -> DataFrame:
    """(tag, total, detected, attributed, recall, attribution): the technique groups summed by the tags that
    (technique_id, tag) gives them, tags of a namespace alone if one is named."""
    t = tags.where(F.startswith("tag", F.lit(namespace)))
    n = groups.where("dimension = 'technique'").join(F.broadcast(t), F.col("value") == F.col("technique_id")).groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("total", "detected", "attributed")])  # a fixed table
    return n.withColumns({"recall": over(F.col("detected"), F.col("total")), "attribution": over(F.col("attributed"), F.col("total"))})


def matrix(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(technique_id, one recall for each mutation): probes against mutations."""
    return rows.where("not benign").groupBy("technique_id").pivot("mutation", kinds).agg(F.round(F.avg(F.col("flagged").cast("double")), 4))


def weak(rows: DataFrame, below: float = 0.8, n: int = 3) -> DataFrame:
    """(technique_id, recall, place, text): techniques of low recall with up to n of their missed texts, a report's
    feature."""
    low = rows.where("not benign").groupBy("technique_id").agg(F.avg(F.col("flagged").cast("double")).alias("r_")).where(F.col("r_") < below)
    missed = rows.where("not benign and not flagged").select("technique_id", "text").distinct()
    place = F.row_number().over(Window.partitionBy("technique_id").orderBy("text")) - 1  # the limit on it is taken before the shuffle
    return missed.withColumn("place", place).where(F.col("place") < n).join(low, "technique_id").select("technique_id", F.round("r_", 4).alias("recall"), "place", "text")


def compared(results: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(tool, n, flagged, mean_score, mean_latency) of several tools' (label, score, latency) tables."""
    out = None
    for tool, df in results.items():
        d = df.select(F.lit(tool).alias("tool"), "label", "score", "latency")
        out = d if out is None else out.union(d)
    if out is None:
        return spark.createDataFrame([], "tool string, n long, flagged long, mean_score double, mean_latency double")
    return out.groupBy("tool").agg(F.count("*").alias("n"), F.count_if(detected(F.col("label"))).alias("flagged"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("latency"), 4).alias("mean_latency"))
