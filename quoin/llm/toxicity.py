"""Toxicity: a learned lexicon as a trie, crossed with Levenshtein automata, and windows that tell quotation from
abuse.

Fitting takes at most `train_rows` labelled rows outside the held-out fold (those with the least hash). Of rows with
one label that are near copies (five words in a row, similarity of 0.8 or more, told by bands of MinHash values) one
counts. Words, and stems that start several of them, become terms
where their share of toxic rows is high and beyond chance. The trie holds the words; the Levenshtein automata of
all of them run over it together: a state is a set of trie nodes, each with the least edits that lead there, and
states and their transitions are made when a text first needs them, then kept. A hit is exact, a stem, obscured (0 for o, @ for a, ...), or one or two edits away, and direct or
quoted: quotation marks around it, or a word of reporting, within `window` words. Evidence is in nats: the
log odds of the sample's rows with this kind of hit of this term. Of direct and of quoted hits the strongest word
counts, and the other different words by the logarithm of their sum, however many there are; all add up, with weights from a logistic regression on the sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import DOCUMENTS, cut, pick, read

# Characters written for letters, quotation marks, words of reporting in four languages.
OBSCURED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
QUOTES = "\"“”„«»‹›‘’"
REPORTING = frozenset(
    "said says wrote called calls quoted quote word term slur insult dit écrit appelle mot terme insulte"
    " sagte schrieb nannte wort begriff beleidigung dijo escribió llamó palabra término insulto".split()
)

KINDS = ("exact", "stem", "obscured", "edit1", "edit2")
PRIOR = {"exact": 1.0, "stem": 1.0, "obscured": 0.95, "edit1": 0.85, "edit2": 0.6}  # parts of a term's evidence before anything is seen
QUOTED = 0.4  # what quotation leaves of these
SHINGLE, BANDS, DEPTH = 5, 16, 8  # of similar rows (0.8) 95 % share a band, of those at 0.5 6 %, at 0.1 none


@dataclass(frozen=True)
class Toxicity:
    train_rows: int = 20_000
    folds: int = 5
    held_fold: int = 0
    window: int = 8
    share: float = 0.8
    stem_share: float = 0.5
    evidence: float = 14.0  # nats by which a term's rows must speak against the overall share
    stems: tuple[int, ...] = (4, 5, 6)
    stem_words: int = 4
    strength: float = 4.0


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Trie:
    """Terms by their characters, and the determinised union of their Levenshtein automata on them. State 0 is
    dead: most words end there after a few characters."""

    def __init__(self, terms, most_states: int = 100_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allow = [0]  # most edits of any term at or below a node
        self.most_states = most_states
        for t in terms:
            node, k = 0, edits_for(len(t))
            self.allow[0] = max(self.allow[0], k)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allow.append(0)
                node = self.children[node][c]
                self.allow[node] = max(self.allow[node], k)
            self.term[node] = t
        self._clear()

    def _clear(self) -> None:
        self.states: list[dict[int, int]] = [{}]
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.steps: list[dict[str, int]] = [{}]
        self.found: list[tuple[int, str] | None] = [None]
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # a term's character that the word lacks
            node = todo.pop()
            d = nodes[node] + 1
            for child in self.children[node].values():
                if d <= self.allow[child] and d < nodes.get(child, 9):
                    nodes[child] = d
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
            ends = [(d, t) for n, d in nodes.items() if (t := self.term[n]) is not None and d <= edits_for(len(t))]
            self.found.append(min(ends, default=None))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        new: dict[int, int] = {}
        for node, d in self.states[state].items():
            if d < self.allow[node]:  # a character too many
                new[node] = min(d + 1, new.get(node, 9))
            for x, child in self.children[node].items():  # the same character, or another
                e = d + (x != c)
                if e <= self.allow[child] and e < new.get(child, 9):
                    new[child] = e
        return self._state(new)

    def search(self, word: str) -> tuple[int, str] | None:
        """The least number of edits and the first term that is so near, if any is near enough for its length."""
        if len(self.states) > self.most_states:
            self._clear()
        state, steps = self.start, self.steps
        for c in word:
            known = steps[state]
            state = known[c] if c in known else known.setdefault(c, self._step(state, c))
            if not state:
                return None
        return self.found[state]


@dataclass
class Lexicon:
    """`strength` is the evidence of each kind of hit of each word and stem (stems with a star), `weight` counts
    the strongest direct and quoted word, the other direct and quoted ones and the length of a text with hits, `floor`
    is the score without hits."""

    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    strength: dict[tuple[str, str], float] = field(default_factory=dict)
    weight: tuple[float, ...] = (1.0, QUOTED, 1.0, QUOTED, 0.0)
    floor: float = 0.05

    def __post_init__(self):
        self.trie, self.known, self.cache = Trie(self.words), frozenset(self.words), {}
        parts = [f"^(?:{'|'.join(map(re.escape, self.stems))})"] if self.stems else []
        if self.words:
            parts.append(f"^(?:{'|'.join(map(re.escape, self.words))})$")
            parts.append(r"\pL[\pL]*[0-9@$]|[0-9@$]+\pL")
        heads, tails = set(), set()
        for w in self.words:
            k = edits_for(len(w))
            if k == 1:  # one edit leaves a half whole, at its end of the word or one off
                heads.add((1, w[: len(w) // 2]))
                tails.add((1, w[len(w) // 2 :]))
            elif k == 2:
                third = len(w) // 3
                heads.add((2, w[:third]))
                tails.add((2, w[-third:]))
                heads.add((third + 2, w[third:-third]))
        parts += [f"^.{{0,{n}}}(?:{'|'.join(sorted(re.escape(h) for m, h in heads if m == n))})" for n in sorted({m for m, _ in heads})]
        parts += [f"(?:{'|'.join(sorted(re.escape(t) for m, t in tails if m == n))}).{{0,{n}}}$" for n in sorted({m for m, _ in tails})]
        self.pattern = "|".join(parts)
        self.longest = max(map(len, self.words), default=0) + 2

    def kind(self, word: str) -> tuple[str, str] | None:
        """What kind of hit a word is, and of which term."""
        if word not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = self._kind(word)
        return self.cache[word]

    def _kind(self, word: str) -> tuple[str, str] | None:
        if term := self._term(word):
            return ("stem" if term.endswith("*") else "exact"), term
        clear = word.translate(OBSCURED)
        if clear != word and any(map(str.isalpha, word)) and (term := self._term(clear)):
            return "obscured", term
        if 4 <= len(word) <= self.longest and (found := self.trie.search(word)):
            return (f"edit{found[0]}", found[1]) if found[0] else None
        return None

    def _term(self, word: str) -> str | None:
        if word in self.known:
            return word
        return next((f"{s}*" for s in self.stems if word.startswith(s)), None)

    def rows_with_hits(self, texts: pa.Array) -> tuple[np.ndarray, dict[str, tuple[str, str]]]:
        """Which texts have words that are hits, and those words' kinds and terms. Distinct words are filtered by pattern and
        then matched."""
        if not self.pattern or not len(texts):
            return np.zeros(len(texts), bool), {}
        lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pN@$]+")
        flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        coded = flat.dictionary_encode()
        maybe = np.flatnonzero(np.asarray(pc.match_substring_regex(coded.dictionary, self.pattern)))
        hit, kinds = np.zeros(len(coded.dictionary), bool), {}
        for i, w in zip(maybe.tolist(), coded.dictionary.take(pa.array(maybe)).to_pylist(), strict=True):
            if kind := self.kind(w):
                hit[i], kinds[w] = True, kind
        total = np.concatenate([[0], np.cumsum(hit[np.asarray(coded.indices)])])
        offsets = offsets - offsets[0]
        return total[offsets[1:]] > total[offsets[:-1]], kinds

    def evidence(self, text: str, kinds: dict[str, tuple[str, str]], window: int) -> list[float]:
        """What the strongest direct and quoted words say, then what the others do, then the logarithm of the number
        of different words, among which some are near a term by chance (0 without hits). A word counts as quoted only if it never is direct."""
        low = text.lower()
        found = list(re.finditer(r"(?:[^\W_]|[@$])+", low))
        words = [m[0] for m in found]
        seen: dict[str, bool] = {}
        for i, word in enumerate(words):
            if word not in kinds or seen.get(word) is False:
                continue
            first, last = max(0, i - window), min(len(words) - 1, i + window)
            before, after = low[found[first].start() : found[i].start()], low[found[i].end() : found[last].end()]
            marks = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            seen[word] = marks or any(w in REPORTING for w in words[first:i])
        most, total = [0.0, 0.0], [0.0, 0.0]
        for word, quoted in sorted(seen.items()):
            nats = self.strength.get(kinds[word], PRIOR[kinds[word][0]])
            most[quoted] = max(most[quoted], nats)
            total[quoted] += nats
        rest = [math.log1p(max(0.0, t - m)) for m, t in zip(most, total, strict=True)]
        return [*most, *rest, math.log(len(set(words))) if seen else 0.0]

    def score(self, text: str, kinds: dict[str, tuple[str, str]], window: int) -> float:
        x = math.log(self.floor / (1 - self.floor)) + sum(w * e for w, e in zip(self.weight, self.evidence(text, kinds, window), strict=True))
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def fold(doc_id, p: Toxicity) -> int:
    """crc32 of the id as text, modulo folds; a null id counts as an empty one."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % p.folds


def _sample(docs: DataFrame, labels: DataFrame, p: Toxicity) -> DataFrame:
    """text and toxic of the training rows. Of several labels of a document the largest counts."""
    labels = pick(labels, {"doc_id": "bigint", "toxic": "int"}).na.drop().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % p.folds != p.held_fold)
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.train_rows)
    return cut(docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def _words(texts: list[str]) -> Iterator[set[str]]:
    for t in texts:
        yield set(re.findall(r"[^\W_]+", t.lower()))


def _surprise(toxic: int, n: int, share: float) -> float:
    """Nats by which `toxic` of n speaks against the overall share (n times the Kullback-Leibler distance)."""
    q = toxic / n
    return n * sum(a * np.log(a / b) for a, b in ((q, share), (1 - q, 1 - share)) if a > 0)


def _bands(text: str) -> list[int]:
    """Keys of the text's MinHash bands. A text of any length is read whole, some thousand shingles at a time."""
    from xxhash import xxh64_digest, xxh64_intdigest

    w = text.lower().split()
    shingles = {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}
    hashes = np.fromiter(map(xxh64_intdigest, shingles), np.uint64, len(shingles))
    rng = np.random.default_rng(7)
    factors, terms = (rng.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) for _ in range(2))
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096, None] ^ terms) * (factors * np.uint64(2) + np.uint64(1))
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    return np.frombuffer(b"".join(xxh64_digest(least[i : i + DEPTH].tobytes()) for i in range(0, len(least), DEPTH)), np.int64).tolist()


def _distinct(sample: DataFrame) -> DataFrame:
    """text and toxic of the sample without near copies: a row stays if in none of its bands another row of its label
    has a smaller hash. Bands are aggregated before the shuffle, so a large group of copies is no hot key."""
    from xxhash import xxh64_intdigest

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            row = [xxh64_intdigest(t) - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(row, pa.int64()), pa.array(map(_bands, texts), pa.list_(pa.int64()))],
                ["text", "toxic", "row", "bands"],
            )

    marked = cut(sample.mapInArrow(mark, "text string, toxic int, row bigint, bands array<bigint>"))
    bands = marked.select("toxic", "row", F.posexplode("bands").alias("band", "key"))
    first = bands.groupBy("toxic", "band", "key").agg(F.min("row").alias("row"))
    stay = first.groupBy("toxic", "row").agg(F.count("*").alias("n")).filter(F.col("n") == BANDS).drop("n")
    return cut(marked.drop("bands").dropDuplicates(["toxic", "row"]).join(stay, ["toxic", "row"]).select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Lexicon:
    """A lexicon from at most `train_rows` labelled rows outside the held-out fold; the driver sees terms, and no more
    than these rows' evidence. Null texts count as empty, rows without id or label are left out. Tables without toxic
    rows, or without others, give an empty lexicon, whose floor is under a half."""
    once = _distinct(_sample(pick(docs, DOCUMENTS), labels, p))
    sizes = {r.toxic: r.n for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, rows = sizes.get(1, 0), sum(sizes.values())
    if not toxic or toxic == rows:
        return Lexicon(floor=min(0.45, (toxic + 0.5) / (rows + 1)))
    share = toxic / rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        t: Counter = Counter()
        for b in batches:
            for words, is_toxic in zip(_words(b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True):
                terms = words | {w[:k] + "*" for w in words for k in p.stems if len(w) > k}
                n.update(terms)
                if is_toxic:
                    t.update(terms)
        names = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([t[x] for x in names], pa.int64()), pa.array([n[x] for x in names], pa.int64())], ["term", "t", "n"])

    counted = once.select("text", "toxic").mapInArrow(count, "term string, t bigint, n bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    found = {r.term: (r.t, r.n) for r in counted.filter(f"t >= 3 and t >= n * if(endswith(term, '*'), {p.stem_share}, {p.share})").collect()}
    sure = {w for w, (t, n) in found.items() if _surprise(t, n, share) >= p.evidence}
    words = {w for w in found if not w.endswith("*")}
    stems: list[str] = []
    for s in sorted((w[:-1] for w in sure if w.endswith("*")), key=lambda s: (len(s), s)):
        if not s.startswith(tuple(stems)) and sum(w.startswith(s) for w in words) >= p.stem_words:
            stems.append(s)
    terms = (*sorted(sure & words), *(f"{s}*" for s in stems))
    base = math.log(share / (1 - share))
    own = {w: math.log((t + 0.5) / (n - t + 0.5)) - base for w in terms for t, n in [found[w]]}
    lexicon = Lexicon(tuple(sorted(sure & words)), tuple(stems))
    return _weigh(replace(lexicon, strength=_strength(lexicon, own, base, once, p)), once, p)


def _strength(lexicon: Lexicon, own: dict[str, float], base: float, once: DataFrame, p: Toxicity) -> dict[tuple[str, str], float]:
    """Evidence of each kind of hit of each term: the log odds of the sample's rows with such hits, smoothed by
    `strength` rows of what the kind leaves of the term's `own`. So a misspelling tells as much as the term does,
    unless the words near it turn out to be others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            maybe, words = lexicon.rows_with_hits(b.column(0))
            for text, toxic, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), maybe.tolist(), strict=True):
                if m:
                    hits = {words[w] for w in re.findall(r"(?:[^\W_]|[@$])+", text.lower()) if w in words}
                    n.update((*hit, int(toxic == 1)) for hit in hits)
        yield pa.RecordBatch.from_pylist([{"kind": k, "term": t, "toxic": x, "n": c} for (k, t, x), c in n.items()], pa.schema([("kind", pa.string()), ("term", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    seen = once.mapInArrow(count, "kind string, term string, toxic int, n bigint").groupBy("kind", "term", "toxic").agg(F.sum("n").alias("n"))
    rows = {(r.kind, r.term, r.toxic): r.n for r in seen.collect()}
    out = {}
    for term, nats in own.items():
        for kind in KINDS:
            clean, toxic = (rows.get((kind, term, x), 0) for x in (0, 1))
            q = 1 / (1 + math.exp(-PRIOR[kind] * nats - base))
            out[kind, term] = max(0.0, math.log((toxic + p.strength * q) / (clean + p.strength * (1 - q))) - base)
    return out


def _weigh(lexicon: Lexicon, once: DataFrame, p: Toxicity) -> Lexicon:
    """The lexicon with weights and floor from the sample's evidence, equal rows as one with their number."""

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe, words = lexicon.rows_with_hits(b.column(0))
            said = [lexicon.evidence(t, words, p.window) if m else [0.0] * len(lexicon.weight) for t, m in zip(b.column(0).to_pylist(), maybe.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.list_(pa.float64())), b.column(1)], ["said", "toxic"])

    found = once.mapInArrow(speak, "said array<double>, toxic int").groupBy("said", "toxic").count().collect()
    found.sort(key=lambda r: (r.said, r.toxic))  # sums in one order
    x = np.array([[1.0, *r.said] for r in found])
    start = np.array([0.0, *lexicon.weight])
    beta = logistic(x, np.array([float(r.toxic) for r in found]), np.array([float(r["count"]) for r in found]), start, p.strength)
    return replace(lexicon, weight=tuple(beta[1:].tolist()), floor=min(0.45, 1 / (1 + math.exp(-beta[0]))))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray, strength: float) -> np.ndarray:
    """Weights of n times each row by damped Newton steps, drawn to `start` with `strength` (the first column, of
    ones, hardly). A weight that would turn negative, but for the first and the last, is zero, and the others are fitted
    without it: a hit never speaks for a text, while length may."""
    pull = np.array([1e-3, *[strength] * (x.shape[1] - 1)])
    free = np.ones(x.shape[1], bool)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (pull * (b - start) ** 2)[free].sum())

    while True:
        beta = np.where(free, start, 0.0)
        for _ in range(100):
            q = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
            slope = (x.T @ (n * (q - y)) + pull * (beta - start))[free]
            curve = (x.T * (n * q * (1 - q))) @ x + np.diag(pull)
            step, scale = np.zeros(len(beta)), 1.0
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope)
            while scale > 1e-6 and loss(beta - scale * step) > loss(beta):
                scale /= 2
            beta = beta - scale * step
            if np.abs(scale * step).max() < 1e-9:
                break
        wrong = (beta < 0) & free
        wrong[[0, -1]] = False
        if not wrong.any():
            return beta
        free &= ~wrong


def _scores(lexicon: Lexicon, texts: pa.Array, p: Toxicity, step: int = 1024) -> list[float]:
    """A few rows at a time, since the words of a text take several times its size."""
    out = []
    for at in range(0, len(texts), step):
        part = pc.fill_null(texts.slice(at, step).cast(pa.large_string()), "")
        maybe, words = lexicon.rows_with_hits(part)
        scores = [lexicon.floor] * len(part)
        for i in np.flatnonzero(maybe).tolist():
            scores[i] = lexicon.score(part[i].as_py(), words, p.window)
        out += scores
    pa.default_memory_pool().release_unused()
    return out


def score(docs: DataFrame, lexicon: Lexicon, p: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null texts count as empty and get the share of toxic rows
    among those without hits. Rows without id count as held out. Repeated rows give repeated rows, an empty table
    none. Texts of any length are read whole, each in one task. Hits of all kinds add up; a word near several
    terms is a hit of the nearest, of equally near ones of the first by name. Equal texts have equal scores."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _scores(lexicon, b.column(1), p)
            held = [fold(d, p) == p.held_fold for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return pick(docs, DOCUMENTS).mapInArrow(apply, "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, lexicon: Lexicon, p: Toxicity = Toxicity()) -> DataFrame:
    """The rows whose text scores under 0.5, with all columns, also those whose names clash. Null texts count as
    empty and stay, rows without id are judged by their texts, repeated rows stay or go together, very long texts are
    read whole, an empty table stays empty."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(lexicon, texts, p), pa.float64())

    at = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    return at.filter(scored(F.col(f"_{docs.columns.index('text')}").cast("string")) < 0.5).toDF(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
