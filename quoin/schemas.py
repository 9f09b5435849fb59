"""Relations and nested types. Constraints that a struct type can't hold are predicates (`valid_*`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed sets that answers are checked against.
CATEGORIES = (
    "judgment", "constitutional", "statute_bill", "legal_institutional", "intl_law",
    "policy_governance", "economy", "environment_science", "intl_relations", "security_defence",
    "social_issues", "awards_misc", "bihar_state", "other",
)
EXAM_TAGS = ("judiciary", "apo", "bpsc", "upsc", "general")
PROVISION_KINDS = ("constitution", "act", "section", "bill", "rule")

CASE = "struct<case_name: string, court: string, bench: array<string>, holding: string>"
EXTRACTION = (
    f"struct<summary: string, key_points: array<string>, case: {CASE}, provisions: array<struct<name: string, kind: string>>, "
    "exam_relevance: string, event_date: date, evidence: array<struct<quote: string>>>"
)
CLASSIFY_ITEM = "struct<id: int, relevant: boolean, category: string, exam_tags: array<string>, score: double, reason: string>"

ISSUES = "id bigint, issue_date date, filename string, pdf_sha256 string, status string, note string, created_at timestamp"
ARTICLES = (
    "id bigint, issue_id bigint, page_no int, section string, headline string, body string, content_hash string, incomplete boolean, "
    "prefilter_passed boolean, prefilter_score float, classify_status string, relevant boolean, category string, exam_tags array<string>, "
    "relevance_score float, reason string"
)
EXTRACTIONS = (
    f"article_id bigint, data {EXTRACTION}, validation_status string, warnings array<string>, model string, prompt_version string, "
    "search_text string, tsv array<struct<term: string, positions: array<int>>>, embedding array<float>, created_at timestamp"
)
FEEDBACK = "id bigint, article_id bigint, vote int, note string, created_at timestamp"
TABLES = {"issues": ISSUES, "articles": ARTICLES, "extractions": EXTRACTIONS, "feedback": FEEDBACK}

SPANS = "issue string, page int, block int, line int, span int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double"
BLOCKS = "issue string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, nchars int"
PAGES = "issue string, page int, width double, height double"


def _within(c: Column, least: int, most: int) -> Column:
    return c.isNotNull() & F.length(c).between(least, most)


def valid_classify_item(item: Column) -> Column:
    """True or false, never null."""
    tags = F.coalesce(item["exam_tags"], F.array().cast("array<string>"))
    ok = (
        item["id"].isNotNull() & item["relevant"].isNotNull() & item["category"].isin(*CATEGORIES)
        & F.forall(tags, lambda t: t.isin(*EXAM_TAGS)) & item["score"].between(0, 1) & _within(item["reason"], 0, 300)
    )
    return F.coalesce(ok, F.lit(False))


def valid_batch(items: Column) -> Column:
    """One bad item rejects the whole batch."""
    return F.coalesce(items.isNotNull() & F.forall(items, valid_classify_item), F.lit(False))


def valid_extraction(x: Column) -> Column:
    none = F.array().cast("array<struct<name: string, kind: string>>")
    ok = (
        _within(x["summary"], 0, 800) & x["key_points"].isNotNull() & (F.size(x["key_points"]) <= 6) & _within(x["exam_relevance"], 0, 400)
        & x["evidence"].isNotNull() & F.size(x["evidence"]).between(1, 5) & F.forall(x["evidence"], lambda e: _within(e["quote"], 15, 400))
        & F.forall(F.coalesce(x["provisions"], none), lambda p: p["name"].isNotNull() & p["kind"].isin(*PROVISION_KINDS))
    )
    return F.coalesce(ok, F.lit(False))
