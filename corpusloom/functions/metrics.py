"""Quality measures of predictions, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.plans.session import cut


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(cls, precision, recall, f1, support); a ratio without cases is 0."""
    both = df.select(F.explode(F.array(F.struct(F.col(label).alias("cls"), F.lit(1).alias("is"), F.lit(0).alias("said")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("is"), F.lit(1).alias("said")))).alias("r"), (F.col(label) == F.col(predicted)).cast("int").alias("hit"))
    g = both.groupBy("r.cls").agg(F.sum("r.is").alias("support"), F.sum("r.said").alias("said"), F.sum(F.col("r.is") * F.col("hit")).alias("tp"))
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    g = g.select("cls", p.alias("precision"), r.alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return g.select("cls", "precision", "recall", f1.alias("f1"), "support")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counting half; null without both classes.

    Scores are counted per value and range-partitioned; negatives below a value are those of the ranges before (one number
    a partition) and those before it in its own range. So no task sees all scores.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    ranged = cut(per.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in ranged.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        offsets.append((part, before))
        before += n
    sent = F.broadcast(df.sparkSession.createDataFrame(offsets, "part int, start long"))
    run = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.join(sent, "part").withColumn("nb", F.col("start") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    won = below.agg(F.sum(F.col("p") * (F.col("nb") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))
