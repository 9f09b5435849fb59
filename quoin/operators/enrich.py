"""Enrichment by outside models: prompts are columns, calls run through `calls.ask`, answers are checked strictly.

A batch of articles, or one, is one call. Calls are never behind a `when`: a stage's result is written before
anything filters it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.operators.calls import DONE, QUOTA, Invalid, Outcome, Providers, ask, instructed
from quoin.schemas import CATEGORIES, CLASSIFY_ITEM, EXAM_TAGS, EXTRACTION, PROVISION_KINDS
from quoin.sources.ledger import Ledger


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise Invalid(what)


def as_int(x: object, what: str) -> int:
    if isinstance(x, bool | int):
        return int(x)
    if isinstance(x, float) and x.is_integer() or isinstance(x, str) and re.fullmatch(r"\s*[+-]?\d+(?:\.0+)?\s*", x):
        return int(float(x))
    raise Invalid(f"{what}: not an integer")


def as_float(x: object, what: str) -> float:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise Invalid(f"{what}: not a number") from None


# The words read as true and false.
_TRUE, _FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def as_bool(x: object, what: str) -> bool:
    word = str(int(x) if isinstance(x, float) and x.is_integer() else x).lower()
    _need(word in _TRUE + _FALSE, f"{what}: not true or false")
    return word in _TRUE


def as_text(x: object, what: str, least: int = 0, most: int | None = None) -> str:
    _need(isinstance(x, str), f"{what}: not a text")
    _need(least <= len(x) and (most is None or len(x) <= most), f"{what}: {len(x)} characters")
    return x


def as_list(x: object, what: str, least: int = 0, most: int | None = None) -> list:
    _need(isinstance(x, list), f"{what}: not a list")
    _need(least <= len(x) and (most is None or len(x) <= most), f"{what}: {len(x)} items")
    return x


def as_date(x: object, what: str) -> date | None:
    """An ISO date, an ISO time at midnight, or seconds since 1970 at midnight."""
    if x is None:
        return None
    try:
        at = datetime.fromtimestamp(x, timezone.utc) if isinstance(x, int | float) else datetime.fromisoformat(str(x))
    except (ValueError, OverflowError):
        raise Invalid(f"{what}: not a date") from None
    _need((at.hour, at.minute, at.second, at.microsecond) == (0, 0, 0, 0), f"{what}: not midnight")
    return at.date()


def _dict(x: object, what: str) -> dict:
    _need(isinstance(x, dict), f"{what}: not an object")
    return x


def _one_of(x: object, among: tuple[str, ...], what: str) -> str:
    _need(x in among, f"{what}: {x!r}")
    return x


def check_batch(x: object) -> list[dict]:
    """Items of a classification; any bad one rejects all."""
    out = []
    for i, item in enumerate(as_list(_dict(x, "answer").get("items"), "items")):
        d, at = _dict(item, f"items.{i}"), f"items.{i}."
        score = as_float(d.get("score"), at + "score")
        _need(0 <= score <= 1, at + "score: not within 0 and 1")
        out.append(
            {
                "id": as_int(d.get("id"), at + "id"), "relevant": as_bool(d.get("relevant"), at + "relevant"), "category": _one_of(d.get("category"), CATEGORIES, at + "category"),
                "exam_tags": [_one_of(t, EXAM_TAGS, at + "exam_tags") for t in as_list(d.get("exam_tags", []), at + "exam_tags")], "score": score,
                "reason": as_text(d.get("reason"), at + "reason", most=300),
            }
        )
    return out


def check_extraction(x: object) -> dict:
    d = _dict(x, "answer")
    maybe = lambda v, what: None if v is None else as_text(v, what)
    case = None
    if d.get("case") is not None:
        c = _dict(d["case"], "case")
        case = {k: maybe(c.get(k), f"case.{k}") for k in ("case_name", "court", "holding")} | {"bench": [as_text(b, "case.bench") for b in as_list(c.get("bench", []), "case.bench")]}
    provisions = [_dict(p, "provisions") for p in as_list(d.get("provisions", []), "provisions")]
    return {
        "summary": as_text(d.get("summary"), "summary", most=800),
        "key_points": [as_text(k, "key_points") for k in as_list(d.get("key_points"), "key_points", most=6)],
        "case": case,
        "provisions": [{"name": as_text(p.get("name"), "provisions.name"), "kind": _one_of(p.get("kind"), PROVISION_KINDS, "provisions.kind")} for p in provisions],
        "exam_relevance": as_text(d.get("exam_relevance"), "exam_relevance", most=400),
        "event_date": as_date(d.get("event_date"), "event_date"),
        "evidence": [{"quote": as_text(_dict(e, "evidence").get("quote"), "evidence.quote", 15, 400)} for e in as_list(d.get("evidence"), "evidence", 1, 5)],
    }


def _object(**parts: dict) -> dict:
    return {"type": "object", "properties": parts, "required": [k for k, v in parts.items() if "default" not in v]}


def _text(most: int | None = None, least: int | None = None) -> dict:
    return {"type": "string"} | ({"maxLength": most} if most else {}) | ({"minLength": least} if least else {})


def _list(of: dict, most: int | None = None, least: int | None = None, **more) -> dict:
    return {"type": "array", "items": of} | ({"maxItems": most} if most else {}) | ({"minItems": least} if least else {}) | more


def _maybe(of: dict) -> dict:
    return {"anyOf": [of, {"type": "null"}], "default": None}


# What the checks below let through, as JSON Schema.
BATCH_FORM = _object(
    items=_list(
        _object(
            id={"type": "integer"}, relevant={"type": "boolean"}, category={"enum": list(CATEGORIES)}, exam_tags=_list({"enum": list(EXAM_TAGS)}, default=[]),
            score={"type": "number", "minimum": 0, "maximum": 1}, reason=_text(300),
        )
    )
)
EXTRACTION_FORM = _object(
    summary=_text(800), key_points=_list(_text(), 6),
    case=_maybe(_object(case_name=_maybe(_text()), court=_maybe(_text()), bench=_list(_text(), default=[]), holding=_maybe(_text()))),
    provisions=_list(_object(name=_text(), kind={"enum": list(PROVISION_KINDS)}), default=[]), exam_relevance=_text(400),
    event_date=_maybe({"type": "string", "format": "date"}), evidence=_list(_object(quote=_text(400, 15)), 5, 1),
)

CLASSIFY_SYSTEM = (
    "Rate every numbered article for a reader's study notes and return an item with the same number as id. Pick the one category that fits best, and every tag whose readers "
    "should see the article. The score is your estimate of how likely it belongs in the notes, and relevant says whether you would keep it. Give your reason in one line."
)
EXTRACT_SYSTEM = (
    "Fill in the form from the article below and from nothing else. Leave a field null or empty if the article is silent on it. Each evidence quote must occur in the article exactly as you give it."
)


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


CLASSIFIED = "id bigint, status string, relevant boolean, category string, exam_tags array<string>, score double, reason string"


def classify(pending: DataFrame, providers: Providers, system: str = CLASSIFY_SYSTEM, size: int = 8, cut: float = 0.4, opening: int = 700, lanes: int = 1, ledger: Ledger | None = None) -> DataFrame:
    """pending: id, issue_id, seq, headline, body. One call for each `size` rows of an issue, by seq. A row whose
    number the answer lacks, or whose batch failed, is failed; with used-up quota its status is quota. Of several
    answers for a row the last counts; relevant needs a score of `cut`, compared before it is rounded."""
    rows = pending.select("issue_id", F.floor((F.col("seq") - 1) / size).alias("batch"), F.struct("seq", "id", _or_empty("headline").alias("h"), F.left(_or_empty("body"), F.lit(opening)).alias("t")).alias("row"))
    batches = rows.groupBy("issue_id", "batch").agg(F.min("row.id").alias("key"), F.array_sort(F.collect_list("row")).alias("rows"))
    numbered = F.transform("rows", lambda r, i: F.concat(F.lit("["), i.cast("string"), F.lit("] HEADLINE: "), r["h"], F.lit("\nTEXT: "), r["t"]))
    calls = batches.select("key", F.array_join(numbered, "\n\n").alias("user"), F.struct("issue_id", "batch").alias("order"))
    answers = ask(calls, providers, instructed(system, BATCH_FORM), check_batch, f"array<{CLASSIFY_ITEM}>", lanes, ledger)
    each = batches.select("key", F.posexplode("rows.id").alias("n", "id")).join(answers, "key")
    mine = F.filter("value", lambda a: a["id"] == F.col("n"))
    each = each.select("id", "status", F.when(F.size(mine) > 0, F.element_at(mine, -1)).alias("a"))
    done = F.col("a").isNotNull()
    status = F.when(done, DONE).when(F.col("status") == QUOTA, QUOTA).otherwise("failed")
    return each.select("id", status.alias("status"), (F.col("a.relevant") & (F.col("a.score") >= cut)).alias("relevant"), "a.category", "a.exam_tags", "a.score", "a.reason")


def extract(pending: DataFrame, providers: Providers, system: str = EXTRACT_SYSTEM, most: int = 50, opening: int = 12_000, lanes: int = 1, ledger: Ledger | None = None) -> DataFrame:
    """pending: id, issue_id, seq, issue_date, headline, body. article_id, status, model and data: one call a row, for
    the first `most` of each issue; failed rows stay pending."""
    user = F.concat(F.lit("ISSUE DATE: "), F.coalesce(F.col("issue_date").cast("string"), F.lit("unknown")), F.lit("\nHEADLINE: "), _or_empty("headline"), F.lit("\n\nARTICLE TEXT:\n"), F.left(_or_empty("body"), F.lit(opening)))
    calls = pending.filter(F.col("seq") <= most).select(F.col("id").alias("key"), user.alias("user"), F.struct("issue_id", "seq").alias("order"))
    answers = ask(calls, providers, instructed(system, EXTRACTION_FORM), check_extraction, EXTRACTION, lanes, ledger)
    return answers.select(F.col("key").alias("article_id"), "status", F.col("provider").alias("model"), F.col("value").alias("data"))


def reply(providers: Providers, system: str, user: str) -> Outcome:
    """One free text, on the driver."""
    return providers.text([{"role": "system", "content": system}, {"role": "user", "content": user}])


def embed(pending: DataFrame, encode: Callable[[list[str]], list[list[float]] | None], dim: int, size: int = 16, lanes: int = 8) -> DataFrame:
    """pending: article_id, search_text. Vectors in calls of `size` texts, by as many tasks at once as there are lanes; a batch whose call fails, or gives other
    lengths, is left out and stays pending."""

    def call(frames):
        for rows in frames:
            ids, vectors = [], []
            for a in range(0, len(rows), size):
                part = rows.iloc[a : a + size]
                try:
                    got = encode(part["search_text"].fillna("").tolist())
                except Exception:  # an embedding never stops the pipeline
                    got = None
                if got and len(got) == len(part) and all(len(v) == dim for v in got):
                    ids += part["article_id"].tolist()
                    vectors += [[float(x) for x in v] for v in got]
            yield pd.DataFrame({"article_id": pd.Series(ids, dtype="int64"), "embedding": vectors})

    return pending.select("article_id", "search_text").repartition(lanes, "article_id").sortWithinPartitions("article_id").mapInPandas(call, "article_id bigint, embedding array<float>")
