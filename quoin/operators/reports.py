"""Daily brief, statistics, feedback, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brief(cards: DataFrame) -> DataFrame:
    """Cards with seq, their place in their date's brief: best score first, then page, then id."""
    order = (F.desc_nulls_last("relevance_score"), F.asc_nulls_last("page_no"), F.asc("id"))
    return cards.withColumn("seq", F.row_number().over(Window.partitionBy("issue_date").orderBy(*order)))


def issue_dates(issues: DataFrame) -> DataFrame:
    return issues.select("issue_date").orderBy(F.desc("issue_date"))


def issue_stats(issues: DataFrame, articles: DataFrame, extractions: DataFrame) -> DataFrame:
    """A row for each issue, also those without articles."""
    a = articles.select("id", "issue_id", "prefilter_passed", "relevant")
    e = extractions.select("article_id")
    joined = issues.select(F.col("id").alias("issue"), "issue_date", "status", "note").join(a, F.col("issue") == F.col("issue_id"), "left").join(e, F.col("id") == F.col("article_id"), "left")
    return joined.groupBy(F.col("issue").alias("issue_id"), "issue_date", "status", "note").agg(
        F.count("id").alias("articles"), F.count_if("prefilter_passed").alias("passed_prefilter"),
        F.count_if("relevant").alias("relevant"), F.count("article_id").alias("extracted"),
    )


def feedback_summary(feedback: DataFrame, articles: DataFrame, issues: DataFrame, limit: int = 100) -> DataFrame:
    """Votes by article, most rejected first. Votes are summed before anything is joined."""
    votes = feedback.groupBy("article_id").agg(
        F.sum(F.when(F.col("vote") == 1, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("vote") == -1, 1).otherwise(0)).alias("down"), F.max("created_at").alias("last"),
    )
    a = articles.select(F.col("id").alias("article_id"), "issue_id", "headline", "page_no")
    i = issues.select(F.col("id").alias("issue_id"), "issue_date")
    joined = votes.join(a, "article_id").join(i, "issue_id")
    top = joined.orderBy(F.desc("down"), F.desc("last"), "article_id").limit(limit)
    return top.select("article_id", "headline", "page_no", "issue_date", "up", "down", "last")


def ui_filter(categories: list[str], tag: str = "all") -> Column:
    right = F.col("category").isin(*categories)
    return right if tag == "all" else right & F.array_contains("exam_tags", tag)


def verified(cards: DataFrame) -> DataFrame:
    return cards.filter("validation_status <> 'needs_review'")


def hidden_count(cards: DataFrame) -> DataFrame:
    return cards.groupBy("issue_date").agg(F.count_if(F.col("validation_status") == "needs_review").alias("hidden"))


def top_picks(brief: DataFrame, n: int = 5) -> DataFrame:
    return brief.filter(F.col("seq") <= n)


def remainder(brief: DataFrame, categories: list[str], n: int = 5) -> DataFrame:
    """What follows the top picks, with its category's place in the given order; other categories are left out."""
    place = F.array_position(F.array(*(F.lit(c) for c in categories)), F.col("category"))
    return brief.filter(F.col("seq") > n).withColumn("category_no", place.cast("int")).filter("category_no > 0")


def category_counts(brief: DataFrame, n: int = 5) -> DataFrame:
    return brief.filter(F.col("seq") > n).groupBy("issue_date", "category").agg(F.count("*").alias("notes"))


def note_markdown(labels: dict[str, str] | None = None) -> Column:
    """A card as Markdown."""
    label = F.col("category")
    for name, text in (labels or {}).items():
        label = F.when(F.col("category") == name, text).otherwise(label)
    d = F.col("data")
    head = F.concat(F.lit("## "), F.col("headline"), F.lit("  (p."), F.col("page_no").cast("string"), F.lit(" | "), label, F.lit(")"))
    provisions = F.when(F.size(d["provisions"]) > 0, F.concat(F.lit("**Provisions:** "), F.array_join(F.transform(d["provisions"], lambda p: p["name"]), ", ")))
    points = F.transform(d["key_points"], lambda k: F.concat(F.lit("- "), k))
    return F.concat_ws("\n", head, d["summary"], F.lit(""), points, provisions, F.lit(""), F.concat(F.lit("_Exam angle (AI note): "), d["exam_relevance"], F.lit("_")), F.lit(""))


def markdown(brief: DataFrame, title: str, labels: dict[str, str] | None = None) -> DataFrame:
    """issue_date and markdown, one document a date."""
    notes = brief.select("issue_date", "seq", note_markdown(labels).alias("note")).groupBy("issue_date").agg(F.array_sort(F.collect_list(F.struct("seq", "note"))).alias("ns"))
    head = F.concat(F.lit(f"# {title} - "), F.date_format("issue_date", "dd MMM yyyy"))
    return notes.select("issue_date", F.concat_ws("\n", head, F.lit(""), F.transform("ns", lambda x: x["note"])).alias("markdown"))


def chips(card_tags: str = "exam_tags") -> Column:
    """Category, status and tags as one line of labels."""
    return F.concat_ws(" ", F.transform(F.concat(F.array("category", "validation_status"), F.col(card_tags)), lambda x: F.concat(F.lit("`"), x, F.lit("`"))))
