"""Gold labels, and precision and recall against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_export(articles: DataFrame, issues: DataFrame, snippet: int = 250) -> DataFrame:
    """What a person labels: an empty `human` column beside each article's opening."""
    i = issues.select(F.col("id").alias("issue_id"), "issue_date")
    a = articles.join(i, "issue_id")
    return a.select("issue_date", "content_hash", "page_no", "headline", F.left(F.coalesce("body", F.lit("")), F.lit(snippet)).alias("snippet"), F.lit("").alias("human"))


def gold(labels: DataFrame) -> DataFrame:
    """labels: content_hash, human, file_no, row_no. The last usable label of a hash counts."""
    usable = labels.withColumn("human", F.trim("human")).filter(F.col("human").isin("0", "1"))
    return usable.groupBy("content_hash").agg(F.max_by(F.col("human").cast("int"), F.struct("file_no", "row_no")).alias("gold"))


def scores(articles: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: labelled, positives, prefilter_recall, tp, fp, fn, precision, recall, f1. A hash in two issues
    counts twice; an article not judged yet counts as not relevant."""
    rows = articles.select("content_hash", "prefilter_passed", "relevant").join(gold, "content_hash")
    yes, found = F.col("gold") == 1, F.coalesce("relevant", F.lit(False))
    passed = F.coalesce("prefilter_passed", F.lit(False))
    n = rows.agg(
        F.count("*").alias("labelled"), F.count_if(yes).alias("positives"), F.count_if(yes & passed).alias("_passed"),
        F.count_if(found & yes).alias("tp"), F.count_if(found & ~yes).alias("fp"), F.count_if(~found & yes).alias("fn"),
    )
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    n = n.withColumn("prefilter_recall", F.col("_passed") / at_least_one(F.col("positives"))).drop("_passed")
    n = n.withColumn("precision", F.col("tp") / at_least_one(F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / at_least_one(F.col("tp") + F.col("fn")))
    return n.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))
