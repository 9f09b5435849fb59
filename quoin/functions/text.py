"""Text functions as columns. NFKC has no built-in function; it is the one Arrow UDF, and everything else stays in
the JVM. `(?U)` makes Java's classes Unicode's."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SOFT_HYPHEN = "­"
# Markers, section labels and dates as newspapers print them.
CONTINUED_FROM = r"(?iU)continued\s+from\s*\S{0,2}\s*page\s*(\d+)"
CONTINUED_ON = r"(?iU)continued\s+on\s*\S{0,2}\s*page\s*(\d+)"
CROSS_REFERENCE = r"(?iU)(?:more\s+reports|details)\s+on\s*\S{0,2}\s*page\s*\d+|see\s+also\s*\S{0,2}\s*page\s*\d+"
SECTION_LABELS = (
    "CITY", "NORTH", "EAST", "WEST", "SOUTH", "NATION", "WORLD", "NEWS", "EDITORIAL", "OPED", "SPORT",
    "BUSINESS", "ENTERTAINMENT", "EDUCATION", "SCIENCE",
)
WEEKDAY_DATE = r"(?iU)(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)[,\s]+([a-z]+)\s+(\d{1,2}),?\s+(20\d{2})"
FILE_DATE = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})"
_CONTROL = "".join(chr(i) for i in (*range(32), 127) if chr(i) not in "\n\t")
NUMBER = r"\d[\d,]*\.?\d*"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x), na_action="ignore")


# All control characters but \n and \t, the soft hyphen, and all above the last letters before the first unassigned character.
_SUSPECT = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\xAD\x{378}-\x{10FFFF}]"


def strip_bad_chars(c: Column) -> Column:
    """Without control, private, unassigned and surrogate characters, U+FFFD and soft hyphens; \\n and \\t stay."""
    def others(t: Column) -> Column:
        return F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, "[\\p{Cc}\\p{Co}\\p{Cn}\\p{Cs}\\uFFFD\\u00AD&&[^\\n\\t]]", ""))

    return let(c, lambda t: F.when(t.rlike(_SUSPECT), let(F.translate(t, _CONTROL, ""), others)).otherwise(t))


def clean_text(c: Column) -> Column:
    """Line-end soft hyphens join words, others become hyphens; compatibility forms are unified; bad characters
    go; hyphenated line ends join; line breaks and runs of blanks become one space.

    Most texts need few of these steps, and to find a fixed string is much faster than to match a pattern. ASCII texts
    are in that form already and don't go to Python."""
    soft = F.regexp_replace(F.regexp_replace(c, f"(?U){SOFT_HYPHEN}\\s*\\n\\s*", ""), SOFT_HYPHEN, "-")
    c = F.when(c.contains(SOFT_HYPHEN), soft).otherwise(c)
    c = strip_bad_chars(F.coalesce(nfkc(F.when(F.octet_length(c) != F.length(c), c)), c))
    c = let(c, lambda t: F.when(t.contains("-\n"), F.regexp_replace(t, r"(?<=[a-z])-\n(?=[a-z])", "")).otherwise(t))
    return strip(let(F.replace(c, F.lit("\n"), F.lit(" ")), _single_spaced))


def _single_spaced(t: Column) -> Column:
    """Runs of white space become one space. Of white space, NFKC and strip_bad_chars leave these characters."""
    runs = reduce(Column.__or__, (t.contains(x) for x in ("  ", "\t", "\u1680", "\u2028", "\u2029")))
    return F.when(runs, F.regexp_replace(t, r"(?U)\s{2,}", " ")).otherwise(t)


def strip(c: Column) -> Column:
    inked = lambda x: (x >= "!") & (x <= "~")
    ends = lambda t: inked(F.substr(t, F.lit(1), F.lit(1))) & inked(F.substr(t, F.lit(-1), F.lit(1)))
    return let(c, lambda t: F.when(ends(t), t).otherwise(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))


# Latin, Greek and Cyrillic characters and general punctuation that become spaces; NUL has a meaning of its own in `translate`.
_SPACED = "".join(chr(i) for i in (*range(1, 48), *range(58, 97), *range(123, 0x530), *range(0x2000, 0x2070)))


def _tidy(c: Column) -> Column:
    """Classes of characters take long to match, so what is a space after a translation goes without."""

    def joined(t: Column) -> Column:
        some = F.replace(F.replace(t, F.lit("   "), F.lit(" ")), F.lit("  "), F.lit(" "))
        return let(some, lambda s: F.when(s.contains("  "), F.regexp_replace(s, "  +", " ")).otherwise(s))

    spaced = F.translate(F.lower(c), _SPACED, " " * len(_SPACED))
    plain = lambda t: (F.octet_length(t) == F.length(t)) & ~t.contains("\0")
    return let(spaced, lambda t: F.trim(F.when(plain(t), joined(t)).otherwise(F.regexp_replace(t, "[^0-9a-zऀ-ॿ]+", " "))))


def norm(c: Column, unify: bool = True) -> Column:
    """Lower-case letters, digits and Devanagari, every run of anything else one space. `unify` applies NFKC first;
    without it no Python runs, for texts known to be in that form."""
    return _tidy(nfkc(c) if unify else c)


def let(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _names_page(t: Column) -> Column:
    """Every marker and reference has this word. The class of a letter has no others here, so ASCII's cases do."""
    return t.rlike("(?i)page")


def marker(c: Column, pattern: str) -> Column:
    """page: the page number of the first marker (null without one); rest: the text with it replaced by a space."""

    def cut(t: Column, found: Column) -> Column:
        at = F.instr(t, found)
        rest = F.concat(F.substr(t, F.lit(1), at - 1), F.lit(" "), F.substr(t, at + F.length(found), F.lit(2147483647)))
        page = F.try_to_number(F.regexp_extract(found, pattern, 1), F.lit("999999999")).cast("int")
        return F.struct(F.when(found != "", page).alias("page"), F.when(found != "", strip(rest)).otherwise(t).alias("rest"))

    return let(c, lambda t: let(F.when(_names_page(t), F.regexp_extract(t, pattern, 0)).otherwise(""), lambda found: cut(t, found)))


def pop_marker(c: Column, pattern: str) -> tuple[Column, Column]:
    popped = marker(c, pattern)
    return popped["page"], popped["rest"]


def without_references(c: Column) -> Column:
    """Each reference to another page becomes a space."""
    return let(c, lambda t: F.when(_names_page(t), F.regexp_replace(t, CROSS_REFERENCE, " ")).otherwise(t))


def section_of(top_text: Column) -> Column:
    """The first section label in text from the top of a page."""
    return F.nullif(F.regexp_extract(F.upper(top_text), rf"(?U)\b({'|'.join(SECTION_LABELS)})\b", 1), F.lit(""))


def _first_date(text: Column, pattern: str, order: tuple[int, int, int], form: str) -> Column:
    return F.try_to_date(F.concat_ws(" ", *(F.regexp_extract(text, pattern, i) for i in order)), form)


def issue_date(first_page: Column, second_page: Column, filename: Column) -> Column:
    """From a weekday and date on the first page or else the second, or from digits in the file name; null if no
    such date exists. Of each text only the first match counts."""
    printed = [_first_date(F.coalesce(p, F.lit("")), WEEKDAY_DATE, (1, 2, 3), "MMMM d yyyy") for p in (first_page, second_page)]
    return F.coalesce(*printed, _first_date(F.coalesce(filename, F.lit("")), FILE_DATE, (1, 2, 3), "yyyy MM dd"))


def numbers(c: Column) -> Column:
    """The distinct numbers in a text, without thousands separators and trailing points."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"\.+$", "")))


def content_hash(headline: Column, body: Column) -> Column:
    return F.sha1(F.concat(F.coalesce(headline, F.lit("")), F.lit("|"), F.coalesce(body, F.lit(""))).cast("binary"))


def words(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
