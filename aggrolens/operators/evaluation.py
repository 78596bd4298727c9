"""Metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT


def counts(actual: str, predicted: Column) -> list[Column]:
    a = F.col(actual)
    return [F.count_if((a == x) & (predicted == y)).alias(n) for n, x, y in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_metrics(df: DataFrame) -> DataFrame:
    """tn, fp, fn, tp and precision, recall, f1, accuracy (0 where undefined)."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return df.withColumns({"precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6), "accuracy": F.round(ratio(tp + tn, tp + tn + fp + fn), 6)})


def melted(scores: DataFrame) -> DataFrame:
    """One row per document and model from columns nb, lex, hybrid."""
    return scores.withColumn("m", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("score")) for n, c in (("nb", "nb"), ("lexicon", "lex"), ("hybrid", "hybrid"))]))).select("*", "m.*").drop("m")


def sweep(scores: DataFrame, steps: int = 21) -> DataFrame:
    """nb_weight from 0 to 1 in equal steps, with counts and metrics, from scores computed once. Each row is expanded by its few steps and aggregated before any shuffle."""
    w = F.col("step") / (steps - 1)
    d = scores.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    hit = (F.round(w * F.col("nb") + (1 - w) * F.col("lex"), 9) >= DEFAULT.threshold).cast("int")
    return with_metrics(d.groupBy("step").agg(*counts("label", hit))).withColumn("nb_weight", F.round(w, 2)).drop("step")


def ranked(swept: DataFrame) -> DataFrame:
    order = [F.desc("f1"), F.desc("precision"), F.desc("recall"), F.col("nb_weight")]
    return swept.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def class_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of each class, and their macro and weighted means."""
    per = preds.withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    is_, said = F.col("label") == F.col("class"), F.col("predicted") == F.col("class")
    per = per.groupBy("class").agg(F.count_if(is_ & said).alias("tp"), F.count_if(~is_ & said).alias("fp"), F.count_if(is_ & ~said).alias("fn"))
    per = per.select(F.col("class").cast("string").alias("class"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))
    names = ("precision", "recall", "f1")
    mean = per.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro").alias("class"), *names, "support")
    weighted = per.agg(*[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names], F.sum("support").alias("total")).select(F.lit("weighted").alias("class"), *names, F.col("total").alias("support"))
    return per.union(mean).union(weighted).select("class", *[F.round(n, 6).alias(n) for n in names], "support")
