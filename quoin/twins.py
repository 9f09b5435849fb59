"""SQL twins of text and layout operators, as pieces that queries put together. Written for DuckDB."""

from __future__ import annotations

from quoin.functions import text as T
from quoin.operators import prefilter

_WORD = r"[\p{L}\p{M}\p{Nd}_]"
_SPACE = r"[\s\p{Z}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    """Whether a Java pattern with Unicode's word bounds matches, ignoring case."""
    return f"regexp_matches({text}, {quoted('(?i)' + bounded(pattern))})"


def bounded(pattern: str) -> str:
    """Word bounds as the characters beside them, one of which they then hold."""
    out, rest = "", pattern
    while r"\b" in rest:
        before, _, rest = rest.partition(r"\b")
        opening = not before and not out or before.endswith(("|", "(", "(?:"))
        out += before + (r"(?:^|[^\p{L}\p{M}\p{Nd}_])" if opening else r"(?:$|[^\p{L}\p{M}\p{Nd}_])")
    return (out + rest).replace(r"\s", _SPACE).replace(r"\d", r"\p{Nd}")


def prefilter_score(rules: prefilter.Rules, head: str = "headline", whole: str = "headline || chr(10) || body") -> str:
    parts = []
    for patterns, (base, more) in ((rules.strong, rules.strong_score), (rules.weak, rules.weak_score)):
        parts += [f"CASE WHEN {has(whole, p)} THEN {base} + CASE WHEN {has(head, p)} THEN {more} ELSE 0.0 END ELSE 0.0 END" for p in patterns]
    return f"CAST({' + '.join(parts)} AS DOUBLE)"


def strong_hits(rules: prefilter.Rules, whole: str = "headline || chr(10) || body") -> str:
    return "(" + " + ".join(f"CAST({has(whole, p)} AS INTEGER)" for p in rules.strong) + ")"


def hits(rules: prefilter.Rules, whole: str = "headline || chr(10) || body") -> str:
    names = [f"CASE WHEN {has(whole, p)} THEN {quoted(p)} END" for p in (*rules.strong, *rules.weak)]
    return f"concat_ws(' ', {', '.join(names)})"


def replaced(text: str, pattern: str, by: str = "", times: str = ", 'g'") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}{times})"


def stripped(text: str) -> str:
    return replaced(text, rf"^{_SPACE}+|{_SPACE}+$")


def clean(text: str) -> str:
    """`clean_text`, for texts whose only compatibility characters are the two-letter ligatures of f."""
    out = replaced(text, rf"\x{{AD}}{_SPACE}*\n{_SPACE}*")
    out = f"nfc_normalize(replace(replace(replace({out}, chr(173), '-'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))"
    out = replaced(out, r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{E000}-\x{F8FF}\x{FFFD}]")
    for _ in range(2):  # a letter between two line ends belongs to both
        out = replaced(out, r"([a-z])-\n([a-z])", r"\1\2")
    out = replaced(replaced(out, rf"{_SPACE}*\n{_SPACE}*", " "), rf"{_SPACE}{{2,}}", " ")
    return stripped(out)


def _java(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace(r"\s", _SPACE).replace(r"\S", r"[^\s\p{Z}]").replace(r"\d", r"\p{Nd}")


def marker_page(text: str, pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, {quoted(_java(pattern))}, 1), '') AS INTEGER)"


def without_marker(text: str, pattern: str) -> str:
    p = _java(pattern)
    return f"CASE WHEN regexp_matches({text}, {quoted(p)}) THEN {stripped(replaced(text, p, ' ', ''))} ELSE {text} END"


def section(text: str) -> str:
    return f"nullif(regexp_extract(upper({text}), {quoted(rf'(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}_])({"|".join(T.SECTION_LABELS)})(?:$|[^\p{{L}}\p{{M}}\p{{Nd}}_])')}, 1), '')"


def printed_date(text: str) -> str:
    parts = [f"regexp_extract({text}, {quoted(_java(T.WEEKDAY_DATE))}, {i})" for i in (1, 2, 3)]
    return f"CAST(try_strptime(concat_ws(' ', {', '.join(parts)}), '%B %d %Y') AS DATE)"


def stem(w: str) -> str:
    """The English stemmer, for a word in lower case."""
    one = (
        f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN length({w}) > 4 AND regexp_matches({w}, '(?:s|x|z|ch|sh)es$') THEN left({w}, length({w}) - 2) "
        f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND NOT regexp_matches({w}, '(?:ss|us|is)$') THEN left({w}, length({w}) - 1) ELSE {w} END"
    )
    arms = ""
    for end in ("ing", "ed"):
        root = f"left(x, length(x) - {len(end)})"
        twice = f"length({root}) > 3 AND right({root}, 1) = substr({root}, length({root}) - 1, 1) AND right({root}, 1) NOT IN ('l', 's', 'z')"
        arms += f" WHEN x LIKE '%{end}' AND length({root}) > 2 AND regexp_matches({root}, '[aeiouy]') THEN CASE WHEN {twice} THEN left({root}, length({root}) - 1) ELSE {root} END"
    return f"list_transform([{one}], lambda x: CASE{arms} ELSE x END)[1]"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{_WORD}+')"


def n_words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '{_SPACE}+'), lambda w: w <> ''))"


# ---- layout, over the view `blocks`, which has its pages' heights ----
BODY_SIZE = """sizes AS (SELECT issue, arg_max(s, {'n': n, 'p': -page, 'b': -block_no}) AS body_size FROM (
    SELECT issue, round_even(size * 2, 0) / 2 AS s, sum(nchars)::BIGINT AS n, min({'p': page, 'b': block_no}).p AS page, min({'p': page, 'b': block_no}).b AS block_no FROM blocks GROUP BY ALL) GROUP BY issue)"""


def _below(low: str, high: str, reach: float, share: float) -> str:
    gap, narrower = f"({low}.y0 - {high}.y1)", f"least({low}.x1 - {low}.x0, {high}.x1 - {high}.x0)"
    return f"{gap} >= -2 AND {gap} < {low}.size * {reach} AND greatest(0.0, least({low}.x1, {high}.x1) - greatest({low}.x0, {high}.x0)) / greatest({narrower}, 1e-6) > {share}"


def _fold(name: str, source: str, holds: str, pick: str, text: str, deck: str) -> str:
    """Boxes one after another: each is taken in by one of those so far (`k`) that hold it (`h`), or stands alone."""
    grown = f"{{'y0': k.y0, 'x0': least(k.x0, h.x0), 'x1': greatest(k.x1, h.x1), 'y1': greatest(k.y1, h.y1), 'size': k.size, 'text': {text}, 'deck': {deck}}}"
    return f"""{name} AS (SELECT issue, page, body_size, boxes, 1 AS i, boxes[1:0] AS done FROM {source} UNION ALL SELECT * FROM (SELECT issue, page, body_size, boxes, i + 1,
      CASE WHEN spot IS NULL THEN list_append(done, h) ELSE list_transform(done, lambda k, j: CASE WHEN j = spot THEN {grown} ELSE k END) END
      FROM (SELECT *, {pick}(list_filter(list_transform(done, lambda k, j: CASE WHEN {holds} THEN j END), lambda j: j IS NOT NULL)) AS spot FROM (SELECT *, boxes[i] AS h FROM {name} WHERE i <= len(boxes)))))"""


SEGMENTS = f"""{BODY_SIZE},
inside AS (SELECT * FROM blocks JOIN sizes USING (issue) WHERE y0 >= height * 0.03 AND y1 <= height * (1 - 0.03)),
raw AS (SELECT * FROM inside WHERE size >= body_size * 1.35 AND length(text) BETWEEN 8 AND 220 AND NOT regexp_full_match({stripped('text')}, '\\p{{Nd}}+')),
tall AS (SELECT issue, page, any_value(body_size) AS body_size, list({{'y0': y0, 'x0': x0, 'x1': x1, 'y1': y1, 'size': size, 'text': text, 'deck': []::VARCHAR[]}} ORDER BY y0, x0, block_no) AS boxes FROM raw GROUP BY issue, page),
{_fold('merging', 'tall', _below('h', 'k', 1.2, 0.5) + ' AND abs(h.size - k.size) < 1.5', 'list_min', "k.text || chr(10) || h.text", 'k.deck')},
merged AS (SELECT issue, page, any_value(body_size) AS body_size, list(b ORDER BY b.y0, b.x0, n) AS boxes FROM (SELECT issue, page, body_size, unnest(done) AS b, generate_subscripts(done, 1) AS n FROM merging WHERE i > len(boxes)) GROUP BY issue, page),
{_fold('decking', 'merged', 'k.size >= h.size * 1.15 AND h.size <= 1.8 * body_size AND ' + _below('h', 'k', 2.5, 0.3), 'list_max', 'k.text', 'list_append(k.deck, h.text)')},
heads AS (SELECT issue, page, n - 1 AS head, b.x0, b.x1, b.y1, b.text, array_to_string(b.deck, chr(10)) AS deck FROM (SELECT issue, page, unnest(done) AS b, generate_subscripts(done, 1) AS n FROM decking WHERE i > len(boxes))),
assigned AS (SELECT b.issue, b.page, b.block_no, b.x0, b.y0, b.text, arg_max(h.head, {{'y': h.y1, 'i': -h.head}}) AS head FROM inside b JOIN heads h ON h.issue = b.issue AND h.page = b.page AND h.y1 <= b.y0 + 3
  AND (greatest(0.0, least(b.x1, h.x1) - greatest(b.x0, h.x0)) / greatest(b.x1 - b.x0, 1e-6) >= 0.5 OR (b.x0 >= h.x0 - 5 AND b.x0 <= h.x1 + 5))
  WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.issue = b.issue AND r.page = b.page AND r.block_no = b.block_no) GROUP BY ALL),
gaps AS (SELECT *, rx - lag(rx) OVER (PARTITION BY issue, page, head ORDER BY rx) > 15 AS new FROM (SELECT *, round_even(x0, 0) AS rx FROM assigned)),
placed AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY issue, page, head ORDER BY rx RANGE UNBOUNDED PRECEDING) AS col FROM gaps),
bodies AS (SELECT issue, page, head, string_agg(text, chr(10) ORDER BY col, y0, block_no) AS body FROM placed GROUP BY ALL),
cleaned AS MATERIALIZED (SELECT issue, page, head, {clean('h.text')} AS headline, {clean("h.deck || chr(10) || b.body")} AS body FROM heads h JOIN bodies b USING (issue, page, head) WHERE {n_words('h.text')} >= 2),
popped AS MATERIALIZED (SELECT issue, page, head, headline, {marker_page('body', T.CONTINUED_FROM)} AS continued_from, {without_marker('body', T.CONTINUED_FROM)} AS body FROM cleaned),
segments AS (SELECT issue, page, CAST(head AS INTEGER) AS head, headline, {replaced(without_marker('body', T.CONTINUED_ON), _java(T.CROSS_REFERENCE), ' ')} AS body, {marker_page('body', T.CONTINUED_ON)} AS continues_on, continued_from FROM popped)"""

# Lines of a block, six of them, one after another: g is the group, w and n what the group has so far.
BUILT = """lines AS (SELECT issue, page, block_no // 6 AS block, block_no AS line, trim(text, ' ' || chr(9) || chr(13)) AS text, length(trim(text, ' ' || chr(9) || chr(13))) AS n, CASE WHEN block_no % 5 = 0 THEN 14.0 ELSE 9.0 END::DOUBLE AS size, block_no % 2 = 0 AS bold,
  row_number() OVER (PARTITION BY issue, page, block_no // 6 ORDER BY block_no) AS i FROM blocks WHERE trim(text, ' ' || chr(9) || chr(13)) <> ''),
walk AS (SELECT issue, page, block, i, n * size AS w, n::BIGINT AS k, 0 AS g FROM lines WHERE i = 1 UNION ALL SELECT * FROM (SELECT issue, page, block, i, CASE WHEN fresh THEN 0 ELSE w END + n * size, CASE WHEN fresh THEN 0 ELSE k END + n, g + CAST(fresh AS INTEGER)
  FROM (SELECT l.*, w, k, g, greatest(w / k, size) / least(w / k, size) > 1.25 AS fresh FROM walk JOIN lines l ON l.issue = walk.issue AND l.page = walk.page AND l.block = walk.block AND l.i = walk.i + 1)))"""

# ---- similarity of short texts (120 characters at most), over a table `asked` of pairs (a, b) ----
LCS = """walk AS (SELECT a, b, 0 AS i, (1::HUGEINT << len(a)) - 1 AS bits FROM asked UNION ALL SELECT a, b, i + 1, ((bits + (bits & hit)) | (bits - (bits & hit))) & ((1::HUGEINT << len(a)) - 1)
    FROM (SELECT *, list_sum(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN a[j] = b[i + 1] THEN 1::HUGEINT << (j - 1) ELSE 0::HUGEINT END))::HUGEINT AS hit FROM walk WHERE i < len(b) AND len(a) > 0)),
  lcs AS (SELECT a, b, CASE WHEN len(a) = 0 THEN 0 ELSE len(a) - bit_count(bits) END AS n FROM walk WHERE i = len(b) OR len(a) = 0)"""


def token_sides(name: str, source: str) -> str:
    """`name`: the rows of `source` (k, a, b) with their distinct words x and y, those in both, and each side's others as l and r."""
    own = lambda c: f"list_filter(list_distinct(regexp_split_to_array({c}, '\\s+')), lambda w: w <> '')"
    rest = lambda a, b: f"array_to_string(list_sort(list_filter({a}, lambda w: NOT list_contains({b}, w))), ' ')"
    return f"""{name} AS (SELECT k, x, y, array_to_string(list_sort(list_intersect(x, y)), ' ') AS base, {rest("x", "y")} AS l, {rest("y", "x")} AS r
    FROM (SELECT k, {own("a")} AS x, {own("b")} AS y FROM {source}))"""


def token_set(n: str) -> str:
    """From the columns of token_sides and the LCS `n` of l and r."""
    joint = "(len(base) + CASE WHEN base <> '' THEN 1 ELSE 0 END)"
    arm = lambda side: f"CASE WHEN base <> '' THEN 200.0::DOUBLE * len(base) / (2 * len(base) + 1 + len({side})) ELSE 0 END"
    return f"""CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN base <> '' AND (l = '' OR r = '') THEN 100.0
    ELSE greatest({arm("l")}, {arm("r")}, 200.0::DOUBLE * ({joint} + {n}) / (2 * {joint} + len(l) + len(r))) END::DOUBLE"""


def stretches(name: str, source: str) -> str:
    """`name`: for the rows of `source` (k, a, b) the shorter text s and every stretch w of the longer one that counts."""
    return f"""{name} AS (SELECT k, s, substr(t, greatest(i, 0) + 1, least(i + len(s), len(t)) - greatest(i, 0)) AS w
    FROM (SELECT *, unnest(range(1 - len(s), len(t))) AS i FROM (SELECT k, CASE WHEN len(a) > len(b) THEN b ELSE a END AS s, CASE WHEN len(a) > len(b) THEN a ELSE b END AS t FROM {source}) WHERE s <> ''))"""
