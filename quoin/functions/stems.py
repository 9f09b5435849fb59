"""English text as a search vector: words stemmed by the published English Snowball rules, with their positions."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# The English stop list that goes with the stemmer.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

# Words with stems of their own, words left alone, and the rules' suffixes with what takes their place.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ALONE = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
ALONE_SINGULAR = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
HEADS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
BEFORE_LI = "cdeghkmnrt"

VOWEL = "[aeiouy]"
SHORT = r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"  # a short syllable at the end
REGION = r"^.*?[aeiouy][^aeiouy]"
WORD = r"(?:[^\W_]|[ऀ-ॿ])+"


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def _after(w: str, start: int) -> int:
    """Where the region behind the first consonant after a vowel begins, from `start` on."""
    found = re.match(REGION, w[start:])
    return start + found.end() if found else len(w)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2 or word in ALONE:
        return word
    if word in OWN:
        return OWN[word]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    head = next((h for h in HEADS if w.startswith(h)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    w = _plural(w)
    if w not in ALONE_SINGULAR:
        w = _verb(w, r1)
        if w[-1] in "yY" and len(w) > 2 and w[-2] not in "aeiouy":
            w = w[:-1] + "i"
        w = _ending(w, r1, r2)
    return w.replace("Y", "y")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        return w[:-1]
    return w


def _verb(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    root = w[: len(w) - len(end)]
    if end in ("eed", "eedly"):
        return root + "ee" if len(root) >= r1 else w
    if not end or not re.search(VOWEL, root):
        return w
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if root.endswith(DOUBLES):
        return root[:-1]
    return root + "e" if len(root) <= r1 and re.search(SHORT, root) else root


def _ending(w: str, r1: int, r2: int) -> str:
    end = _longest(w, STEP_2)
    root = w[: len(w) - len(end)]
    if end and len(root) >= r1 and (end != "ogi" or root.endswith("l")) and (end != "li" or root[-1:] in BEFORE_LI and root):
        w = root + STEP_2[end]
    end = _longest(w, STEP_3)
    root = w[: len(w) - len(end)]
    if end and len(root) >= (r2 if end == "ative" else r1):
        w = root + STEP_3[end]
    end = _longest(w, STEP_4)
    root = w[: len(w) - len(end)]
    if end and len(root) >= r2 and (end != "ion" or root[-1:] in ("s", "t")):
        w = root
    root = w[:-1]
    if w.endswith("e") and (len(root) >= r2 or len(root) >= r1 and not re.search(SHORT, root)):
        return root
    return root if w.endswith("ll") and len(root) >= r2 else w


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


VECTOR = ArrayType(StructType([StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))]))


TOGETHER = 128  # texts whose words are Python objects at a time, whatever the size of a batch


@F.arrow_udf(VECTOR)
def _vectors(texts: pa.Array) -> pa.Array:
    parts = [_vectors_of(texts.slice(i, TOGETHER).to_pylist()) for i in range(0, len(texts), TOGETHER)]
    return pa.concat_arrays(parts) if parts else _vectors_of([])


def _vectors_of(texts: list[str | None]) -> pa.Array:
    sizes, terms, counts, positions = [0], [], [0], []
    for text in texts:
        at: dict[str, list[int]] = {}
        for i, w in enumerate(tokens(text or ""), 1):
            if w not in STOP:
                at.setdefault(stem(w), []).append(i)
        for term in sorted(at):
            terms.append(term)
            positions += at[term]
            counts.append(len(positions))
        sizes.append(len(terms))
    lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(positions, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(terms, pa.string()), lists], ["term", "positions"]))


def search_vector(text: Column) -> Column:
    """Terms in order, each with the ascending positions of its words. Stop words are left out but keep their
    positions; null is empty. Words are runs of letters and digits."""
    return _vectors(text)


def stem_sql(words: str) -> str:
    """SQL for a table (w, stem) from the table `words` of distinct words w in lower case: the same rules in steps."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)

    def cases(rules: dict[str, str], region: dict[str, str], extra: dict[str, str], value: str = "v") -> str:
        whens = []
        for s in sorted(rules, key=len, reverse=True):
            root = f"left({value}, length({value}) - {len(s)})"
            fits = f"length({value}) - {len(s)} >= {region.get(s, region[''])}" + (f" AND {extra[s].format(root)}" if s in extra else "")
            whens.append(f"WHEN suffix({value}, '{s}') THEN CASE WHEN {fits} THEN {root} || '{rules[s]}' ELSE {value} END")
        return "CASE " + " ".join(whens) + f" ELSE {value} END"

    root = "regexp_replace(v, '(edly|ingly|ed|ing)$', '')"
    after = lambda start: f"coalesce({start} + nullif(length(regexp_extract(substr(m, {start} + 1), '{REGION}')), 0), length(m))"
    own = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OWN.items())
    li = f"regexp_matches({{}}, '[{BEFORE_LI}]$')"
    return f"""stem_1 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS m FROM {words}),
  stem_2 AS (SELECT *, CASE WHEN regexp_matches(m, '^({"|".join(HEADS)})') THEN length(regexp_extract(m, '^({"|".join(HEADS)})')) ELSE {after("0")} END AS r1 FROM stem_1),
  stem_3 AS (SELECT *, {after("r1")} AS r2, CASE WHEN suffix(m, 'sses') THEN left(m, length(m) - 2) WHEN regexp_matches(m, 'ie[ds]$') THEN left(m, length(m) - CASE WHEN length(m) > 4 THEN 2 ELSE 1 END)
    WHEN suffix(m, 's') AND NOT regexp_matches(m, '[us]s$') AND regexp_matches(left(m, length(m) - 2), '{VOWEL}') THEN left(m, length(m) - 1) ELSE m END AS v FROM stem_2),
  stem_4 AS (SELECT *, CASE WHEN regexp_matches(v, 'eed(ly)?$') THEN CASE WHEN length(regexp_replace(v, 'eed(ly)?$', '')) >= r1 THEN regexp_replace(v, 'eed(ly)?$', 'ee') ELSE v END
    WHEN regexp_matches(v, '(edly|ingly|ed|ing)$') AND regexp_matches({root}, '{VOWEL}') THEN CASE WHEN regexp_matches({root}, '(at|bl|iz)$') THEN {root} || 'e'
      WHEN regexp_matches({root}, '({"|".join(DOUBLES)})$') THEN left({root}, length({root}) - 1) WHEN length({root}) <= r1 AND regexp_matches({root}, '{SHORT}') THEN {root} || 'e' ELSE {root} END
    ELSE v END AS v4 FROM stem_3),
  stem_5 AS (SELECT w, r1, r2, v AS v3, CASE WHEN length(v4) > 2 AND regexp_matches(v4, '[^aeiouy][yY]$') THEN left(v4, length(v4) - 1) || 'i' ELSE v4 END AS v FROM stem_4),
  stem_6 AS (SELECT w, r1, r2, v3, {cases(STEP_2, {"": "r1"}, {"ogi": "suffix({}, 'l')", "li": li})} AS v FROM stem_5),
  stem_7 AS (SELECT w, r1, r2, v3, {cases(STEP_3, {"": "r1", "ative": "r2"}, {})} AS v FROM stem_6),
  stem_8 AS (SELECT w, r1, r2, v3, {cases(dict.fromkeys(STEP_4, ""), {"": "r2"}, {"ion": "regexp_matches({}, '[st]$')"})} AS v FROM stem_7),
  stem_9 AS (SELECT w, v3, CASE WHEN suffix(v, 'e') AND (length(v) > r2 OR (length(v) > r1 AND NOT regexp_matches(left(v, length(v) - 1), '{SHORT}'))) THEN left(v, length(v) - 1)
    WHEN suffix(v, 'll') AND length(v) > r2 THEN left(v, length(v) - 1) ELSE v END AS v FROM stem_8),
  stems AS (SELECT w, CASE WHEN length(w) <= 2 OR w IN ({quoted(ALONE)}) THEN w WHEN w IN ({quoted(OWN)}) THEN CASE w {own} END
    WHEN v3 IN ({quoted(ALONE_SINGULAR)}) THEN v3 ELSE replace(v, 'Y', 'y') END AS stem FROM stem_9)"""
