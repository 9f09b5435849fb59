"""Checks of extracted claims against their source text.

Containment runs in the JVM; only claims that are not contained verbatim go through the fuzzy Arrow UDF, which
tests that itself first (a guard around a UDF would not spare its calls).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.similarity import partial_reaches

FUZZY_FROM = 6  # shorter needles must be contained


def present_exact(needle: Column, hay: Column) -> Column:
    """Both normalised; an empty needle is never present."""
    return F.coalesce((needle != "") & hay.contains(needle), F.lit(False))


LONGEST = 64  # bytes of a passage that are looked up
BITS = 22  # of the map that tells which stretches may begin a passage
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def _stretches(data: bytes, size: int) -> np.ndarray:
    """A 64-bit number for each stretch of `size` bytes: equal stretches, equal numbers."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8) + np.uint64(1)) * _powers(int(STEP), len(data))[:-1], dtype=np.uint64)])
    found = (sums[size:] - sums[:-size]) * _powers(pow(int(STEP), -1, 1 << 64), len(data))[: len(data) - size + 1]
    return found * np.uint64(0xD6E8FEB86659FD93)


def _first_stretch(size: pd.Series, needle: pd.Series) -> pd.Series:
    """The number of a passage's first bytes, as many as `size` tells."""
    return pd.Series([int(_stretches(t.encode()[:n], n)[0].astype(np.int64)) for n, t in zip(size, needle, strict=True)], dtype="int64")


def _begun(marks: dict[int, bytes]):
    """For each text the stretches (size, number) that may begin a passage, by a map of bits for each size."""

    @F.pandas_udf("array<struct<_size: int, _key: bigint>>")
    def find(texts: pd.Series) -> pd.Series:
        maps = {n: np.frombuffer(bits, np.uint8) for n, bits in marks.items()}

        def of(text: str | None) -> list[dict]:
            data, out = (text or "").encode(), []
            for n, bits in maps.items():
                if len(data) < n:
                    continue
                keys = _stretches(data, n)
                place = (keys >> np.uint64(64 - BITS)).astype(np.int64)
                hits = np.unique(keys[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1].astype(np.int64))
                out += [{"_size": n, "_key": k} for k in hits.tolist()]
            return out

        return texts.map(of)

    return find


def holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """texts: id and text; passages: item_id and needle; both normalised. id and item_id of every passage that a text
    holds verbatim, which may begin and end within words.

    Both sides meet by an equal key before they are compared: a number of a passage's first bytes, 64 of them or the next
    smaller power of two. Of a text's stretches only those become rows that a map of bits (half a megabyte for each of
    the seven sizes) does not rule out, and a text goes on only with these."""
    size = F.least(F.lit(LONGEST), F.pow(F.lit(2), F.floor(F.log2(F.octet_length("needle")))).cast("int"))
    number = F.pandas_udf(_first_stretch, "bigint")
    keyed = passages.filter("needle <> ''").withColumn("_size", size).withColumn("_key", number("_size", "needle"))
    place = F.shiftrightunsigned("_key", 64 - BITS)
    cells = keyed.select("_size", F.shiftright(place, 3).alias("cell"), F.pmod(place, F.lit(8)).alias("bit")).distinct()
    marks: dict[int, np.ndarray] = {}
    for r in cells.groupBy("_size", "cell").agg(F.sum(F.expr("shiftleft(1, cast(bit as int))")).alias("bits")).toLocalIterator():  # 2^19 cells of a size at most
        marks.setdefault(r._size, np.zeros(1 << BITS - 3, np.uint8))[r.cell] = r.bits
    if not marks:
        return texts.select("id").crossJoin(passages.select("item_id")).limit(0)
    found = texts.select("id", "text", _begun({n: m.tobytes() for n, m in marks.items()})("text").alias("_found"))
    near = found.select("id", "text", F.explode_outer("_found").alias("k")).select("id", "text", "k.*").join(keyed, ["_size", "_key"])
    return near.filter(present_exact(F.col("needle"), F.col("text"))).select("id", "item_id").distinct()


def present_in(needle: str, hay: str, cut: float) -> bool:
    if not needle:
        return False
    return needle in hay or len(needle) >= FUZZY_FROM and partial_reaches(needle, hay, cut)


def _all_present(cut: float):
    @F.pandas_udf("array<boolean>")
    def check(needles: pd.Series, hay: pd.Series) -> pd.Series:
        return pd.Series([[present_in(n or "", h or "", cut) for n in ([] if ns is None else ns)] for ns, h in zip(needles, hay, strict=True)])

    return check


def _norm_each(xs: Column) -> Column:
    """Normalises an array through one NFKC call on a joined string."""
    joined = F.array_join(F.transform(xs, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\x1f"), F.lit(" "))), "\x1f")
    return F.transform(F.split(T.nfkc(joined), "\x1f"), lambda x: F.trim(F.regexp_replace(F.lower(x), "[^0-9a-zऀ-ॿ]+", " ")))


def present_each(claims: Column, hay: Column, cut: float) -> Column:
    """For each of the claims whether a normalised text holds it, to the letter or nearly."""
    return _all_present(cut)(_norm_each(claims), hay)


def unknown_numbers(claim: Column, body: Column) -> Column:
    """Numbers of the claim that the body lacks, sorted as text."""
    return F.array_sort(F.array_except(T.numbers(claim), T.numbers(body)))


def _kept(xs: Column, flags: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(xs.alias("x"), flags.alias("ok")), lambda z: z["ok"]), lambda z: z["x"])


def validate(rows: DataFrame, quote_cut: float = 90, name_cut: float = 88, strict_numbers: bool = False) -> DataFrame:
    """rows: body and data (an extraction). Adds status, warnings and cleaned data.

    Quotes, provisions, case name, court and bench that the text doesn't hold are dropped with a warning; a date
    whose year and month name are both absent is dropped silently; numbers of the summary and key points that
    the text lacks are warned of. Without a grounded quote the status is needs_review, with warnings partial,
    else verified. `strict_numbers` also drops provisions whose numbers the text lacks, which fuzzy matching
    lets through. Null parts count as empty."""
    none = F.array().cast("array<string>")
    data = F.col("data")
    rows = rows.withColumn("_body", F.coalesce("body", F.lit(""))).withColumn("_hay", T.norm(F.col("_body")))
    rows = rows.withColumn("_ev", F.coalesce(data["evidence"], F.array().cast("array<struct<quote: string>>")))
    rows = rows.withColumn("_pr", F.coalesce(data["provisions"], F.array().cast("array<struct<name: string, kind: string>>")))
    rows = rows.withColumn("_bench", F.coalesce(data["case"]["bench"], none))
    rows = rows.withColumn("_ev_ok", _all_present(quote_cut)(_norm_each(F.transform("_ev", lambda e: e["quote"])), F.col("_hay")))
    names = F.concat(F.array(F.coalesce(data["case"]["case_name"], F.lit("")), F.coalesce(data["case"]["court"], F.lit(""))), F.col("_bench"), F.transform("_pr", lambda x: x["name"]))
    rows = rows.withColumn("_ok", _all_present(name_cut)(_norm_each(names), F.col("_hay")))
    n_bench = F.size("_bench")
    rows = rows.withColumn("_bench_ok", F.slice("_ok", F.lit(3), n_bench)).withColumn("_pr_ok", F.slice("_ok", n_bench + 3, F.size("_pr")))
    if strict_numbers:
        grounded = F.transform("_pr", lambda x: F.size(F.array_except(T.numbers(x["name"]), T.numbers(F.col("_body")))) == 0)
        rows = rows.withColumn("_pr_ok", F.zip_with("_pr_ok", grounded, lambda a, b: a & b))
    rows = rows.withColumn("_ev_kept", _kept(F.col("_ev"), F.slice("_ev_ok", F.lit(1), F.size("_ev")))).withColumn("_pr_kept", _kept(F.col("_pr"), F.col("_pr_ok")))
    rows = rows.withColumn("_bench_kept", _kept(F.col("_bench"), F.col("_bench_ok")))
    no_name = (F.coalesce(data["case"]["case_name"], F.lit("")) != "") & ~F.col("_ok")[0]
    no_court = (F.coalesce(data["case"]["court"], F.lit("")) != "") & ~F.col("_ok")[1]
    lost = F.size("_ev") - F.size("_ev_kept")
    lost_names = F.transform(F.filter("_pr", lambda x: ~F.array_contains("_pr_kept", x)), lambda x: x["name"])
    claim = F.concat_ws(" ", F.coalesce(data["summary"], F.lit("")), F.array_join(F.coalesce(data["key_points"], none), " "))
    rows = rows.withColumn("_unknown", unknown_numbers(claim, F.col("_body")))
    # The texts of the warnings.
    warnings = F.array_compact(
        F.array(
            F.when(lost > 0, F.concat(F.lit("dropped "), lost.cast("string"), F.lit(" ungrounded quote(s)"))),
            F.when(F.size("_pr_kept") < F.size("_pr"), F.concat(F.lit("dropped provision(s) not found in article: "), F.array_join(lost_names, ", "))),
            F.when(no_name, F.concat(F.lit("case_name not in article: "), data["case"]["case_name"])),
            F.when(no_court, F.concat(F.lit("court not in article: "), data["case"]["court"])),
            F.when(F.size("_bench_kept") < n_bench, F.lit("dropped bench name(s) not in article")),
            F.when(F.size("_unknown") > 0, F.concat(F.lit("numbers in summary not found in article: "), F.array_join("_unknown", ", "))),
        )
    )
    rows = rows.withColumn("warnings", warnings)
    status = F.when(F.size("_ev_kept") == 0, "needs_review").when(F.size("warnings") > 0, "partial").otherwise("verified")
    date = data["event_date"]
    dated = F.col("_body").contains(F.year(date).cast("string")) | F.lower("_body").contains(F.lower(F.date_format(date, "MMMM")))
    case = F.when(
        data["case"].isNotNull(),
        F.struct(
            F.when(~no_name, data["case"]["case_name"]).alias("case_name"), F.when(~no_court, data["case"]["court"]).alias("court"),
            F.col("_bench_kept").alias("bench"), data["case"]["holding"].alias("holding"),
        ),
    )
    cleaned = F.struct(
        data["summary"].alias("summary"), data["key_points"].alias("key_points"), case.alias("case"), F.col("_pr_kept").alias("provisions"),
        data["exam_relevance"].alias("exam_relevance"), F.when(dated, date).alias("event_date"), F.col("_ev_kept").alias("evidence"),
    )
    out = rows.withColumn("status", status).withColumn("data", cleaned)
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def search_text(headline: Column, data: Column) -> Column:
    """What search sees of an extraction, a line each; the bench is left out."""
    case = F.filter(F.array(data["case"]["case_name"], data["case"]["court"], data["case"]["holding"]), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.concat_ws("\n", headline, data["summary"], data["key_points"], data["exam_relevance"], F.transform(data["provisions"], lambda p: p["name"]), case)
