"""Keyword scoring with weighted patterns, a cheap gate before anything that costs money.

A pattern's literal parts guard its regular expression: `lower(text)` is made once, and the expression runs only
where a literal it can't match without is present.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default keyword lists.
STRONG = (
    r"supreme court", r"high court", r"collegium", r"constitution bench", r"\barticle\s+\d+", r"\bBNSS?\b", r"\bBSA\b",
    r"bharatiya nyay", r"nagarik suraksha", r"bharatiya sakshya", r"\bIPC\b", r"\bCrPC\b", r"\bPOCSO\b", r"\bbail\b",
    r"\bPIL\b", r"habeas corpus", r"contempt of court", r"law commission", r"\btribunal\b", r"chief justice",
    r"\bjudges?\b", r"\bmagistrate\b", r"\bverdict\b", r"fundamental rights?", r"\bordinance\b", r"\bjudiciary\b",
    r"\bsection\s+\d+", r"constitutional", r"\bacquitt", r"\bconvict", r"\bFIR\b", r"\bwrit\b", r"\bsuo motu\b",
    r"overseas citizen", r"\bOCI\b", r"citizenship",
)
WEAK = (
    r"parliament", r"\bbill\b", r"amendment", r"\bpolice\b", r"\barrest", r"petition", r"election commission",
    r"\bact\b", r"governor", r"\bscheme\b", r"ministry", r"\bpolicy\b", r"\btreaty\b", r"\bUN\b", r"human rights",
    r"\bBihar\b", r"\bPatna\b", r"\bRBI\b", r"\bISRO\b", r"\bclimate\b", r"\bsummit\b", r"\bcommission\b",
    r"\bGDP\b", r"inflation", r"repo rate", r"fiscal", r"\bbudget\b", r"\bFDI\b", r"tariff", r"trade (?:deal|war|agreement)",
    r"demonetis", r"\bUPI\b", r"\bbank(?:s|ing)?\b", r"\bIMF\b", r"world bank", r"cyclone", r"pollution", r"air quality",
    r"biodiversity", r"wildlife", r"satellite", r"vaccine", r"united nations", r"bilateral", r"nuclear", r"sanctions?",
    r"foreign minister", r"external affairs", r"\bMEA\b", r"\bNATO\b", r"\bASEAN\b", r"\bFATF\b", r"terror", r"\bArmy\b",
    r"\bborder\b", r"\bCRPF\b", r"maoist|naxal", r"\byojana\b", r"ayushman", r"\bsurvey\b", r"\bindex\b", r"\bprize\b",
    r"\baward\b", r"\bcensus\b", r"\bcensorship\b", r"\bpresident\b", r"election", r"\bpenetration\b", r"\bTRAI\b",
    r"\bprivacy\b", r"data protection", r"cyclon", r"flood", r"earthquake", r"disaster", r"\bNDRF\b",
    r"pakistan", r"\bchina\b", r"\bnepal\b", r"bangladesh", r"sri lanka", r"afghanistan", r"\biran\b", r"\bpilgrim",
)
JUNK = r"\b(crossword|sudoku|horoscope|weather watch|delhi today|tender notice|classifieds?)\b"
SKIPPED_SECTIONS = ("SPORT", "ENTERTAINMENT")


@dataclass(frozen=True)
class Rules:
    strong: tuple[str, ...] = STRONG
    weak: tuple[str, ...] = WEAK
    junk: str = JUNK
    skipped: tuple[str, ...] = SKIPPED_SECTIONS
    strong_score: tuple[float, float] = (2.0, 1.0)  # anywhere; more if in the headline too
    weak_score: tuple[float, float] = (1.0, 0.5)
    strong_needed: int = 2  # to pass in a skipped section
    min_score: float = 0.0


def guard(pattern: str) -> list[str]:
    """A literal, or one for each alternative, that every match holds; [] if none is safe to take."""
    out = []
    for alternative in pattern.split("|") if "(" not in pattern else [pattern]:
        text = re.split(r"\(|\[|\\s|\\d|\.", re.sub(r"\\b", "", alternative))[0]
        text = re.sub(r".[?*]$", "", text)
        if not text or re.search(r"[\\?*+{}^$|]", text):
            return []
        out.append(text.lower())
    return out


def matches(text: Column, lower: Column, pattern: str) -> Column:
    found = F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))
    literals = guard(pattern)
    return reduce(lambda a, b: a | b, (lower.contains(x) for x in literals)) & found if literals else found


def prefilter(articles: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds passed, score and hits to rows with headline, body and section; nulls count as empty."""
    head = F.coalesce("headline", F.lit(""))
    rows = articles.withColumn("_head", head).withColumn("_text", F.concat(head, F.lit("\n"), F.coalesce("body", F.lit(""))))
    rows = rows.withColumn("_low", F.lower("_text")).withColumn("_low_head", F.lower("_head"))
    patterns = [(p, rules.strong_score) for p in rules.strong] + [(p, rules.weak_score) for p in rules.weak]
    rows = rows.withColumn("_in", F.array(*(matches(F.col("_text"), F.col("_low"), p) for p, _ in patterns)))
    score = F.lit(0.0)
    for i, (p, (base, more)) in enumerate(patterns):
        in_head = F.when(matches(F.col("_head"), F.col("_low_head"), p), more).otherwise(0.0)
        score = score + F.when(F.col("_in")[i], base + in_head).otherwise(0.0)
    names = F.array(*(F.lit(p) for p, _ in patterns))
    strong = F.size(F.filter(F.slice("_in", 1, max(1, len(rules.strong))), lambda x: x)) if rules.strong else F.lit(0)
    junk = F.col("_head").rlike(f"(?iU){rules.junk}")
    skipped = F.coalesce(F.upper("section").isin(*rules.skipped), F.lit(False)) & (strong < rules.strong_needed)
    rows = rows.withColumn("score", F.when(junk, 0.0).otherwise(score)).withColumn("_skip", junk | skipped)
    hits = F.when(junk, F.array().cast("array<string>")).otherwise(F.transform(F.filter(F.arrays_zip(F.col("_in").alias("i"), names.alias("n")), lambda z: z["i"]), lambda z: z["n"]))
    passed = ~F.col("_skip") & (F.col("score") >= rules.min_score)
    return rows.withColumn("passed", passed).withColumn("hits", hits).drop("_head", "_text", "_low", "_low_head", "_in", "_skip")
