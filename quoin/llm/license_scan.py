"""License scans by conditional compression.

Candidate blocks: every template is cut into budget + 1 runs of words, so a text that holds it with at most its budget
of differing words holds one of the runs unchanged; one pass of an Aho-Corasick automaton over a text's words finds
them, and around them Myers' algorithm on words finds the stretches within the budget. Each candidate is compressed
with zstandard alone and with every template as raw dictionary (all as lower-case words, so that line breaks and
capitals don't count), and the templates are ranked by the bytes they save. From the top of the ranking down, the first
template whose exact differences in wording confirm it names the block: they are within its budget, no word that
names the license is missing, and none that names another is there. Blocks go by the bytes saved, and a block that
overlaps none before it is a winner; its differences are reported word by word, with numbers apart as versions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quoin.llm.common import DOCUMENTS, pick, read
from quoin.llm.decontamination import Myers, pieces
from quoin.llm.license_texts import CC_PARTS, NAMING, TEMPLATES


@dataclass(frozen=True)
class LicenseScan:
    """Differing words allowed: `tolerance` of a template's words, and one always from `one_from` words on."""

    tolerance: float = 0.2
    one_from: int = 5
    level: int = 19

    def budget(self, words: int) -> int:
        return max(int(words >= self.one_from), int(self.tolerance * words))


_WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return [m.lower() for m in _WORD.findall(text)]


def _numbers(words: list[str]) -> tuple[str, ...]:
    return tuple(w for w in words if w[0].isdigit())


@dataclass(frozen=True)
class Notice:
    """`begin` and `end` count words of the text."""

    begin: int
    end: int
    license: str
    plain: int
    conditional: int
    missing: str
    added: str
    version: str


def _joined(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted ranges, those that touch as one."""
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], p: LicenseScan):
        import ahocorasick
        import zstandard as z

        def compressor(**more) -> z.ZstdCompressor:
            return z.ZstdCompressor(level=p.level, write_content_size=False, write_checksum=False, write_dict_id=False, **more)

        self.p = p
        self.words = {n: words_of(t) for n, t in templates.items() if words_of(t)}
        self.names = list(self.words)
        self.budget = {n: p.budget(len(ws)) for n, ws in self.words.items()}
        self.myers = {n: (Myers(ws), Myers(ws[::-1])) for n, ws in self.words.items()}
        self.alone = compressor()
        self.given = []
        for ws in self.words.values():
            known = z.ZstdCompressionDict(" ".join(ws).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=p.level)
            self.given.append(compressor(dict_data=known))
        self.naming = {n: NAMING | CC_PARTS if "cc" in ws else NAMING for n, ws in self.words.items()}
        self.named = {n: self.naming[n].intersection(ws) for n, ws in self.words.items()}
        self.numbers = {n: _numbers(ws) for n, ws in self.words.items()}
        alike: dict[tuple, set[tuple]] = {}
        for n, ws in self.words.items():
            alike.setdefault(tuple(w for w in ws if not w[0].isdigit()), set()).add(self.numbers[n])
        self.versions = {n: alike[tuple(w for w in ws if not w[0].isdigit())] for n, ws in self.words.items()}  # of templates that differ in numbers alone
        self.allowed = {n: self.named[n] | self.naming[n].intersection(words_of(n)) for n in self.words}
        runs: dict[str, list[tuple[str, int]]] = {}
        for n, ws in self.words.items():
            for at, run in pieces(ws, self.budget[n]):
                runs.setdefault(f" {' '.join(run)} ", []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for run, where in runs.items():
            self.automaton.add_word(run, (run.count(" ") - 1, where))
        if runs:
            self.automaton.make_automaton()
        self.any = bool(runs)
        self.ranking = lru_cache(100_000)(self._ranking)
        self.differences = lru_cache(100_000)(self._differences)

    def regions(self, words: list[str]) -> dict[str, list[list[int]]]:
        """By template, the ranges of words that hold all its places, apart from each other and in order."""
        line, found = f" {' '.join(words)} ", {}
        counted = at = 0  # hits are by character; words are counted along
        for end, (size, where) in self.automaton.iter(line):
            counted += line.count(" ", at, end + 1)
            at = end + 1
            last = counted - 1  # the run's words end before this one
            for n, offset in where:
                begin, k, m = last - size - offset, self.budget[n], len(self.words[n])
                found.setdefault(n, set()).add((max(0, begin - k), min(len(words), begin + m + k)))
        return {n: _joined(sorted(ranges)) for n, ranges in found.items()}

    def stretches(self, name: str, words: list[str]) -> list[tuple[int, int]]:
        """Stretches within the template's budget and of its naming words, apart from each other: the least differences
        first, of equals the one nearest to the template's length, then the one that ends first."""
        (ahead, back), k, m, near = self.myers[name], self.budget[name], len(self.words[name]), []
        for end, d in enumerate(ahead.distances(words), 1):
            if d > k:
                continue
            have, best = set(), None
            for size, each in enumerate(back.distances(words[max(0, end - m - k) : end][::-1], anchored=True), 1):
                if words[end - size] in self.naming[name]:
                    have.add(words[end - size])
                if each <= k and self.named[name] <= have <= self.allowed[name] and (best is None or (each, abs(size - m)) < best[:2]):
                    best = each, abs(size - m), end, size
            if best:
                near.append(best)
        taken, out = bytearray(len(words)), []
        for _, _, end, size in sorted(near):
            if not any(taken[end - size : end]):
                taken[end - size : end] = b"\1" * size
                out.append((end - size, end))
        return out

    def _confirmed(self, name: str, words: list[str]) -> bool:
        """Every difference counts: words within the budget, none of them a naming word, and no version that another
        template of the same wording has."""
        have = self.naming[name].intersection(words)
        if not self.named[name] <= have <= self.allowed[name] or abs(len(words) - len(self.words[name])) > self.budget[name]:
            return False
        if (numbers := _numbers(words)) != self.numbers[name] and numbers in self.versions[name]:
            return False
        return list(self.myers[name][0].distances(words, anchored=True))[-1] <= self.budget[name]

    def _ranking(self, block: str) -> tuple[int, int, str] | None:
        """The block's size compressed alone and with the template that saves most of those that are confirmed, and that
        template. All templates are ranked; of equal savings the nearer length counts, then the one named first."""
        raw, words = block.encode(), block.split(" ")
        plain = len(self.alone.compress(raw))
        sizes = sorted((len(c.compress(raw)), abs(len(words) - len(self.words[n])), i, n) for i, (n, c) in enumerate(zip(self.names, self.given, strict=True)))
        return next(((plain, size, n) for size, _, _, n in sizes if size < plain and self._confirmed(n, words)), None)

    def _differences(self, name: str, stretch: str) -> tuple[str, str, str]:
        words, template = stretch.split(" "), self.words[name]
        missing, added = [], []
        for tag, a, b, c, d in SequenceMatcher(None, template, words, autojunk=False).get_opcodes():
            if tag != "equal":
                missing += template[a:b]
                added += words[c:d]
        return " ".join(missing), " ".join(added), " ".join(_numbers(words))

    def winners(self, words: list[str]) -> list[Notice]:
        """Of the candidate blocks, by bytes saved, those that overlap none before them."""
        blocks = {(a + begin, a + end) for name, regions in self.regions(words).items() for a, b in regions for begin, end in self.stretches(name, words[a:b])}
        ranked = []
        for begin, end in blocks:
            block = " ".join(words[begin:end])
            if found := self.ranking(block):
                plain, conditional, name = found
                off = abs(end - begin - len(self.words[name]))
                ranked.append((conditional - plain, off, self.names.index(name), begin, end, block, plain, conditional))
        taken, out = bytearray(len(words)), []
        for _, _, number, begin, end, block, plain, conditional in sorted(ranked):
            if not any(taken[begin:end]):
                taken[begin:end] = b"\1" * (end - begin)
                out.append(Notice(begin, end, self.names[number], plain, conditional, *self.differences(self.names[number], block)))
        return sorted(out, key=lambda n: n.begin)

    def notices(self, words: list[str]) -> list[Notice]:
        """In their order. What lies between winners is ranked again, as a notice there may also fit without the
        words that it lost to them."""
        todo, out = [(0, len(words))] if self.any else [], []
        while todo:
            a, b = todo.pop()
            found = self.winners(words[a:b])
            out += [replace(n, begin=a + n.begin, end=a + n.end) for n in found]
            edges = [a, *(a + x for n in found for x in (n.begin, n.end)), b]
            todo += [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if found and x < y]
        return sorted(out, key=lambda n: n.begin)


SCHEMA = "doc_id bigint, block int, start_at int, end_at int, license string, exact boolean, missing string, added string, version string, plain_bytes int, conditional_bytes int, reduction double"


def scan(docs: DataFrame, p: LicenseScan = LicenseScan(), templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each notice found: its number and characters in the text, the license, differences, and what its
    template saves of its compressed bytes.

    Null and empty texts have none; rows without doc_id keep a null; repeated rows repeat theirs; an empty table
    gives none. Texts of any length are searched whole, each within one task. Of notices that save equally many
    bytes in overlapping places, the one nearer to its template's length wins, then the template named first."""
    given = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, p)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            rows = []
            for i in range(len(texts)):
                text = texts[i].as_py()
                found = scanner.notices(words_of(text))
                if not found:
                    continue
                spans, doc = [m.span() for m in _WORD.finditer(text)], batch.column(0)[i].as_py()
                for number, n in enumerate(found):
                    place = spans[n.begin][0], spans[n.end - 1][1]
                    rows.append((doc, number, *place, n.license, not n.missing and not n.added, n.missing, n.added, n.version, n.plain, n.conditional, (n.plain - n.conditional) / n.plain))
            columns = list(zip(*rows, strict=True)) or [()] * 12
            kinds = [pa.int64(), *[pa.int32()] * 3, pa.string(), pa.bool_(), *[pa.string()] * 3, *[pa.int32()] * 2, pa.float64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pick(docs, DOCUMENTS).mapInArrow(run, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
