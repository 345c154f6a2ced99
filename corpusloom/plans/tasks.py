"""Task registries, hyper-parameter grids and tables of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Review domains in the order of the registry, and the grid of the published experiments.
DOMAINS = ("dvd", "books", "kitchen", "electronics")
ALPHAS = (0.1, 1.0, 50.0, 100.0, 150.0, 200.0, 300.0)
ETAS = (0.01, 0.1, 1.0, 10.0)


@dataclass(frozen=True)
class Job:
    """A job id ``dataset:noise:feature type``."""

    task_id: int
    noise: float
    feat_type: int

    @classmethod
    def parse(cls, text: str) -> Job:
        task_id, noise, feat_type = text.split(":")
        return cls(int(task_id), float(noise), int(feat_type))


def review_tasks(spark: SparkSession) -> DataFrame:
    """(task_id, source, target, size): all ordered pairs of domains in both sizes, numbered by size and then by order."""
    names = spark.createDataFrame(list(enumerate(DOMAINS)), "k int, name string").coalesce(1)
    sizes = spark.createDataFrame([("all",), ("small",)], "size string").coalesce(1)
    pairs = names.alias("s").crossJoin(names.alias("t")).where("s.k <> t.k").crossJoin(sizes)
    number = F.row_number().over(Window.orderBy("size", "s.k", "t.k")) - 1
    return pairs.select(number.alias("task_id"), F.col("s.name").alias("source"), F.col("t.name").alias("target"), "size")


def grid(spark: SparkSession, alphas: tuple = ALPHAS, etas: tuple = ETAS) -> DataFrame:
    """(alpha, eta) of all combinations."""
    return spark.createDataFrame([(a, e) for a in alphas for e in etas], "alpha double, eta double")


def best_parameters(scores: DataFrame) -> DataFrame:
    """(task_id, alpha, eta, score): the best score of each task; of equal ones the larger alpha, then the larger eta."""
    best = F.max(F.struct("score", "alpha", "eta")).alias("b")
    return scores.where("score IS NOT NULL").groupBy("task_id").agg(best).select("task_id", "b.alpha", "b.eta", "b.score")


def result_rows(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, row): a table row ``source$->$target & mean & best`` of each task, scores with two decimals."""
    per = scores.where("score IS NOT NULL").groupBy("task_id").agg(F.avg("score").alias("m"), F.max("score").alias("b"))
    name = F.concat("source_domain", F.lit("$\\rightarrow$"), "target_domain")
    row = F.concat(name, F.lit(" & "), F.format_string("%.2f", "m"), F.lit(" & "), F.format_string("%.2f", "b"), F.lit(" \\\\"))
    return per.join(F.broadcast(tasks), "task_id").select("task_id", row.alias("row"))


def write_corpus(df: DataFrame, path: str) -> None:
    """Features or results as parquet, a folder for each domain where there is one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("domain") if "domain" in df.columns else writer).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of numeric text files, a value a line; a line that is no number gives null."""
    lines = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split(F.rtrim("value", F.lit(" \r\n")), "\r?\n")).alias("line", "text"))
    return lines.select("file", "line", F.trim("text").try_cast("double").alias("value"))


def write_registry(registry: DataFrame, path: str) -> None:
    """A task registry (of a few rows) as one parquet file."""
    registry.coalesce(1).write.mode("overwrite").parquet(path)


def write_scores(spark: SparkSession, path: str, task_id: int, result: dict, words: int, feat_type: int, alphas: tuple = ALPHAS, etas: tuple = ETAS) -> None:
    """What ``experiments.benchmark`` returns: PATH/scores as text, a file of two lines (denoising, then domain-regularized accuracy in
    percent) in a folder of the task, readable by ``read_results``; and PATH/parameters as rows of the grid in ascending order."""
    lines = spark.createDataFrame([(0, f"{100 * result['acc_mda']:.6f}"), (1, f"{100 * result['acc_domreg']:.6f}")], "k int, value string")
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(f"{path}/scores/{task_id}")
    rows = [(task_id, k, float(score), float(alpha), float(eta), alpha in alphas and eta in etas, words, feat_type) for k, (score, alpha, eta) in enumerate(result["tried"])]
    grid_ = spark.createDataFrame(rows, "task_id int, place int, score double, alpha double, eta double, of_the_grid boolean, max_words int, feat_type int")
    grid_.coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters/{task_id}")


def job_results(spark: SparkSession, results: list[dict]) -> DataFrame:
    """(task_id, noise, feat_type, base_accuracy, accuracy, row): results of jobs, with a tab-parted row as printed."""
    names = ("task_id", "noise", "feat_type", "base_accuracy", "accuracy")
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in results], "task_id int, noise double, feat_type int, base_accuracy double, accuracy double")
    return df.withColumn("row", F.concat_ws("\t", *[F.col(n).cast("string") for n in names]))
