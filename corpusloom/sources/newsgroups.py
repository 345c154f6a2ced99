"""Newsgroup corpora: categories of the tasks, text clean-up and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Per pair of groups, the categories of class 1 and of class 0, of the source and of the target.
CATEGORIES = {
    "comp_vs_sci": {
        "source": (["comp.graphics", "comp.os.ms-windows.misc"], ["sci.crypt", "sci.electronics"]),
        "target": (["comp.sys.ibm.pc.hardware", "comp.sys.mac.hardware", "comp.windows.x"], ["sci.med", "sci.space"]),
    },
    "rec_vs_talk": {
        "source": (["rec.autos", "rec.motorcycles"], ["talk.politics.guns", "talk.politics.misc"]),
        "target": (["rec.sport.baseball", "rec.sport.hockey"], ["talk.politics.mideast", "talk.religion.misc"]),
    },
    "rec_vs_sci": {
        "source": (["sci.space", "sci.med"], ["rec.autos", "rec.sport.baseball"]),
        "target": (["sci.crypt", "sci.electronics"], ["rec.sport.hockey", "rec.motorcycles"]),
    },
    "sci_vs_talk": {
        "source": (["sci.electronics", "sci.med"], ["talk.politics.misc", "talk.religion.misc"]),
        "target": (["sci.crypt", "sci.space"], ["talk.politics.guns", "talk.politics.mideast"]),
    },
    "comp_vs_rec": {
        "source": (["comp.graphics", "comp.sys.ibm.pc.hardware", "comp.sys.mac.hardware"], ["rec.sport.hockey", "rec.motorcycles"]),
        "target": (["comp.os.ms-windows.misc", "comp.windows.x"], ["rec.autos", "rec.sport.baseball"]),
    },
    "comp_vs_talk": {
        "source": (["comp.graphics", "comp.windows.x", "comp.sys.mac.hardware"], ["talk.politics.mideast", "talk.politics.misc"]),
        "target": (["comp.os.ms-windows.misc", "comp.sys.ibm.pc.hardware"], ["talk.politics.guns", "talk.politics.misc"]),
    },
}


def task(task_id: int) -> tuple[str, bool]:
    """(pair of groups, whether source and target change places) of a task: even ids as listed, odd ids swapped."""
    pairs = list(CATEGORIES)
    if not 0 <= task_id < 2 * len(pairs):
        raise ValueError(f"no newsgroup task {task_id}")
    return pairs[task_id // 2], task_id % 2 == 1


def task_named(source: str, target: str) -> int:
    """The task that adapts from one group of categories to the other, such as sci and comp."""
    for k in range(2 * len(CATEGORIES)):
        pair, swapped = task(k)
        if f"{target}_vs_{source}" == pair and swapped or f"{source}_vs_{target}" == pair and not swapped:
            return k
    raise ValueError(f"no newsgroup task from {source} to {target}")


def task_table(spark: SparkSession) -> DataFrame:
    """(task_id, source, target, size) of all newsgroup tasks."""
    rows = []
    for k in range(2 * len(CATEGORIES)):
        pair, swapped = task(k)
        one, two = pair.split("_vs_")
        rows.append((k, two if swapped else one, one if swapped else two, "all"))
    return spark.createDataFrame(rows, "task_id int, source string, target string, size string")


def category_table(spark: SparkSession) -> DataFrame:
    """(pair, side, cls, category) of all pairs. talk.politics.misc is on both sides of comp_vs_talk, as published."""
    rows = [(p, side, 1 - k, c) for p, sides in CATEGORIES.items() for side, lists in sides.items() for k, cs in enumerate(lists) for c in cs]
    return spark.createDataFrame(rows, "pair string, side string, cls int, category string")


def labelled_posts(posts: DataFrame, task_id: int) -> DataFrame:
    """(doc_id, text, category, domain, label) of a task's posts (doc_id, category, text); domain is source or target."""
    pair, swapped = task(task_id)
    cats = category_table(posts.sparkSession).where(F.col("pair") == pair)
    side = F.when(F.col("side") == ("target" if swapped else "source"), "source").otherwise("target")
    named = cats.select("category", side.alias("domain"), F.col("cls").alias("label"))
    return posts.join(F.broadcast(named), "category").select("doc_id", "text", "category", "domain", "label")  # at most 10 rows


#: Fixed value: the pattern of quoted lines as published with the newsgroup loader of scikit-learn.
QUOTED = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"
#: Lines that part a footer from the text.
PARTING = r"\A[ \t\r-]*\z"


def clean(text: Column) -> Column:
    """A post without its header (up to the first empty line), quoted lines and footer (what follows the last empty or dashed
    line, unless that is the first). Works line by line, so long texts are no problem for the patterns."""
    body = F.when(text.contains("\n\n"), F.substring_index(text, "\n\n", 1)).otherwise(F.lit(""))
    rest = F.when(text.contains("\n\n"), F.right(text, F.length(text) - F.length(body) - 2)).otherwise(text)
    kept = F.filter(F.split(rest, "\n", -1), lambda x: ~x.rlike(QUOTED))
    lines = F.split(F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n")), "\n", -1)
    back = F.array_position(F.reverse(F.transform(lines, lambda x: x.rlike(PARTING))), True)
    size = F.size(lines)
    footed = (back > 0) & (size - back > 0)
    return F.array_join(F.when(footed, F.slice(lines, F.lit(1), F.greatest(size - back, F.lit(0)).cast("int"))).otherwise(lines), "\n")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token, tf) of texts: lower-cased runs of at least two letters, digits or underscores."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))
    return docs.select("doc_id", words.alias("token")).where(F.length("token") >= 2).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
