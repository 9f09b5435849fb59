"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as words: lower case, every run of other characters one space. An item with a budget
of k edits is cut into k + 1 pieces of near equal length. If it occurs in a text with at most k edits, at least
one piece occurs there unchanged, at the item's own place give or take k. An Aho-Corasick automaton finds all
pieces in one pass over a text; each hit names an item and a place, and Myers' bit-parallel algorithm finds the
least edit distance of the item to any stretch of the text around that place.

Most hits of short pieces end earlier: halve the pieces again and again, and j pieces in a row may have j - 1 edits.
If both halves had more than theirs, the whole would too, so in every match some piece is unchanged and all runs of
pieces that hold it keep their budgets. They are tried from the shortest on.

The items go to the executors in blocks of at most `block_chars` characters, so what is broadcast has a fixed
bound; each block is one pass over the texts, and a pass is written before the next block is sent. A match lies
within one text, so texts need no shuffle at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import DOCUMENTS, cut, pick, read
from quoin.llm.lookup import Rows


@dataclass(frozen=True)
class Decontamination:
    """Edits allowed: `rate` of an item's characters, rounded down. An item is looked for with a space before and after
    it, which texts have around all their words: to begin or end within a word costs an edit."""

    rate: float = 0.1
    block_chars: int = 4 << 20

    def budget(self, length: int) -> int:
        return int(self.rate * length)


_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Of items and texts alike."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their places; lengths differ by one at most."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any stretch of a text, a bit for each pattern character."""

    def __init__(self, pattern: str):
        self.m, self.at = len(pattern), {}
        for i, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def distances(self, text, anchored: bool = False) -> list[int]:
        """After each of the text's characters the least distance of the pattern to a stretch that ends there: to
        any, or, `anchored`, to the one from the text's start."""
        m, at = self.m, self.at
        last, full, first = 1 << m - 1, (1 << m) - 1, int(anchored)
        up, down, score, out = full, 0, m, []
        for c in text:
            eq = at.get(c, 0)
            x = eq | down
            d0 = (((x & up) + up) ^ up) | x
            h_up = down | ~(d0 | up) & full
            h_down = up & d0
            if h_up & last:
                score += 1
            elif h_down & last:
                score -= 1
            h_up = (h_up << 1 | first) & full
            h_down = h_down << 1 & full
            up = h_down | ~(d0 | h_up) & full
            down = d0 & h_up
            out.append(score)
        return out

    def best(self, text, anchored: bool = False) -> tuple[int, int]:
        """The least of the distances and the first place where it is reached."""
        scores = self.distances(text, anchored)
        least = min(scores, default=self.m)
        return (least, scores.index(least) + 1) if least < self.m else (self.m, 0)


def chains(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the ranges of pieces that hold it, from the shortest to under the whole."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def halve(lo: int, hi: int) -> None:
        if hi - lo > 1:
            for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
                halve(a, b)
                for i in range(a, b):
                    if b - a > 1:
                        out[i].append((a, b))

    halve(0, n)
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], p: Decontamination):
        import ahocorasick

        self.budget = [p.budget(len(t)) for _, t in items]
        items = [(i, f" {t} ") for i, t in items]
        self.items, self.p = items, p
        places: dict[str, list[tuple[int, int, list]]] = {}
        for n, (_, text) in enumerate(items):
            cut = pieces(text, self.budget[n])
            edges = [*(at for at, _ in cut), len(text)]
            runs = {(a, b): (edges[a], text[edges[a] : edges[b]], b - a - 1) for chain in chains(len(cut)) for a, b in chain}
            for (at, piece), chain in zip(cut, chains(len(cut)), strict=True):
                places.setdefault(piece, []).append((n, at, [runs[r] for r in chain]))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty, self.myers, self.seen = not places, {}, {}
        self.runs, self.tried = {}, {}

    def _distance(self, n: int, window: str) -> tuple[int, int]:
        """Windows that many texts share are verified once."""
        key = (n, window)
        if key not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            if n not in self.myers:
                self.myers[n] = Myers(self.items[n][1])
            self.seen[key] = self.myers[n].best(window)
        return self.seen[key]

    def _kept(self, begin: int, chain: list[tuple[int, str, int]], text: str) -> bool:
        """Whether all runs (place in the item, characters, budget) have few enough edits, the item being at `begin`."""
        for at, run, k in chain:
            key = (run, text[max(0, begin + at - k) : max(0, begin + at + len(run) + k)])
            good = self.tried.get(key)
            if good is None:
                if len(self.tried) > 50_000:
                    self.tried.clear()
                if run not in self.runs:
                    if len(self.runs) > 20_000:
                        self.runs.clear()
                    self.runs[run] = Myers(run)
                good = self.tried[key] = self.runs[run].best(key[1])[0] <= k
            if not good:
                return False
        return True

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, budget, place of its end in the normalised text) of each item found: its best match, the first
        of equals. Places a piece points at lie in windows of the item's length and twice the budget; windows of
        one item that overlap are searched as one."""
        if self.empty or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        length, text = len(text), f" {text} "
        for end, (size, where) in self.automaton.iter(text):
            for n, at, chain in where:
                k, begin = self.budget[n], end - size + 1 - at
                if chain and not self._kept(begin, chain, text):
                    continue
                a, b = begin - k, begin + len(self.items[n][1]) + k
                mine = spans.setdefault(n, [])
                if mine and a <= mine[-1][1] and b >= mine[-1][0]:
                    mine[-1][0], mine[-1][1] = min(a, mine[-1][0]), max(b, mine[-1][1])
                else:
                    mine.append([a, b])
        found = []
        for n, mine in spans.items():
            best: tuple[int, int] | None = None
            for a, b in mine:
                a = max(0, a)
                d, end = self._distance(n, text[a:b])
                if d <= self.budget[n] and (best is None or (d, a + end) < best):
                    best = (d, a + end)
            if best:
                found.append((self.items[n][0], best[0], self.budget[n], min(length, max(0, best[1] - 2))))  # without the spaces
        return found


def _blocks(benchmark: DataFrame, p: Decontamination) -> Iterator[list[tuple[int, str]]]:
    """The distinct normalised items with a letter or digit, by id, in blocks of bounded size."""
    block, size = [], 0
    for row in pick(benchmark, {"item_id": "bigint", "text": "string"}).na.drop().distinct().orderBy("item_id", "text").toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if block and size + len(text) > p.block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


# Up to here Arrow and Python agree on letters, digits and their lower case, but for the dotted capital I.
_SAME = r"[^\x00-\x{24f}]|\x{130}"


def _texts(column: pa.Array) -> list[str]:
    """What `normal` gives, by Arrow where it gives the same."""
    raw = pc.fill_null(column.cast(pa.large_string()), "")
    done = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(raw), r"[^\pL\pN]+", " "), " ").to_pylist()
    for i in pc.indices_nonzero(pc.match_substring_regex(raw, _SAME)).to_pylist():
        done[i] = normal(raw[i].as_py())
    return done


def leaks(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, item_id, edits, budget and end for every text and item that match; a row's own repetitions repeat
    its matches. Of several places with equally few edits the first counts.

    Null texts and items match nothing, nor do items without letters or digits; rows without doc_id keep a null.
    Empty tables give no rows. Of equal items with several ids each is reported. Texts of any length are searched
    whole, each in one task."""
    docs = pick(docs, DOCUMENTS)
    schema = "doc_id bigint, item_id bigint, edits int, budget int, end_at bigint"

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, p)
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    part = b.slice(i, 2048)
                    rows = [(d, *m) for d, t in zip(part.column(0).to_pylist(), _texts(part.column(1)), strict=True) for m in matcher.matches(t)]
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

        return docs.mapInArrow(run, schema)

    found = list(_passes(docs.sparkSession, benchmark, p, search))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def _passes(spark: SparkSession, benchmark: DataFrame, p: Decontamination, search) -> Iterator[DataFrame]:
    """What `search` gives for each block of items. Only the last is left to be run later: the others are written,
    so that one block at a time is held by the executors."""
    blocks = _blocks(benchmark, p)
    block = next(blocks, None)
    while block:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)
        done = search(shared)
        if after:
            done = cut(done)
            shared.destroy()
        yield done
        block = after


def clean(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """The rows whose text matches no item, with all columns.

    With more items than executors hold at once, each block of items gives only the numbers of the rows it matches, and
    the rows are read and dropped once at the end; `docs` must then give its rows alike each time, as a table does.

    Null and empty texts stay, as do repeated rows with clean texts; an empty table stays empty, and an empty
    benchmark leaves all rows. Texts of any length are searched whole. Ties don't matter: any match counts."""
    spark, blocks = docs.sparkSession, _blocks(benchmark, p)
    rows = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    text = F.col(f"_{docs.columns.index('text')}").cast("string")
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return rows.filter(~_leaky(spark.sparkContext.broadcast(first), p)(text)).toDF(*docs.columns)
    rows, found = rows.withColumn("_row", F.monotonically_increasing_id()), []
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast(block)
        found.append(cut(rows.filter(_leaky(shared, p)(text)).select("_row")))
        shared.destroy()
    return Rows(reduce(DataFrame.unionByName, found).distinct()).drop(rows, "_row").drop("_row").toDF(*docs.columns)


def _leaky(shared, p: Decontamination):
    matchers: dict[str, Matcher] = {}

    @F.arrow_udf("boolean")
    def leaky(texts: pa.Array) -> pa.Array:
        if "" not in matchers:
            matchers[""] = Matcher(shared.value, p)
        out = []
        for i in range(0, len(texts), 2048):
            out += [bool(matchers[""].matches(t)) for t in _texts(texts.slice(i, 2048))]
        return pa.array(out, pa.bool_())

    return leaky


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
