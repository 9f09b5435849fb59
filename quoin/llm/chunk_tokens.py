"""Texts to token ids with the tokenizers library, each distinct chunk of text encoded once per worker.

A pre-tokenizer never joins what lies on both sides of certain blanks, so a text's ids are those of its chunks
in a row. `split` names the rule:

- "space": cut before a single space between two characters that are no white space, and between a letter and ASCII
  punctuation other than the apostrophe (byte-level BPE, whose words carry the space before them);
- "blank": cut at ASCII white space and leave it out (tokenizers that drop white space);
- "word": cut also between a letter and ASCII punctuation other than the apostrophe (of these, such whose words hold
  letters alone and take no more of what follows than an apostrophe and letters);
- "none": no cut, for tokenizers of which nothing is known.

Texts with runs of blanks or rare white space take a slower way to the same ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_RARE = "\\x1c-\\x1f\\x85\\xa0 ᠎ -​    　﻿"
_ODD_ARROW = "\\x{02}|[ ][\\t\\n\\v\\f\\r ]|[\\t\\n\\v\\f\\r][ ]|[\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
# Letters but most capitals, one of which (dotted I) becomes a letter and a mark in lower case.
_WORD_ENDS = r"([\p{Ll}\p{Lo}\p{Lm}A-ZÀ-ÖØ-Þ])([!-&(-/:-@\[-`{-~])"
_GLUE = "\x02"  # before punctuation that has been cut from a word; texts that hold it take the slower way
_IS_RARE = re.compile(f"[{_RARE}]")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SLICE_BYTES = 6 << 20
_BLOCK = 512


class _Generation:
    """Chunks with their ids, which lie in a flat pool."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def slots(self, chunks: list[str]) -> np.ndarray:
        """Their places, -1 for those that are not here."""
        return np.fromiter(map(self.slot.get, chunks, repeat(-1)), np.int64, len(chunks))

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if ends.size else 0  # a slice has fewer than 2^31 ids
        at = np.repeat((self.start[slots] - ends + lengths).astype(np.int32), lengths)
        at += np.arange(total, dtype=np.int32)
        return self.pool[at], lengths

    def add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first, at = len(self.slot), self.used
        while at + ids.size > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(chunks) > self.start.size:
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.pool[at : at + ids.size] = ids
        self.start[first : first + len(chunks)] = at + np.cumsum(lengths) - lengths
        self.length[first : first + len(chunks)] = lengths
        self.used += ids.size
        self.slot.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        return np.arange(first, first + len(chunks))


class _Cache:
    """The ids of chunks in two generations: when the young one holds `most`, it becomes the old one, from which
    chunks that come again are taken over, so that frequent ones stay. `before` is put before each chunk,
    after its first `skip` characters are left out.

    With `blank`, what stands between two chunks, new ones are encoded many to a text. Where each begins shows in the
    ids where tokens tell: after a space, the one token that starts with it (byte-level BPE); for a chunk of letters,
    which is one word, the one token that ends a word. Other chunks have a mark after each."""

    MARK, SPACE, WORD_END = "\x01", "Ġ", "</w>"  # the latter two as vocabularies write them

    def __init__(self, tokenizer, before: str, most: int, blank: str | None = None, skip: int = 0):
        self.tokenizer, self.before, self.most, self.blank, self.skip = tokenizer, before, most, blank, skip
        self.mark = tokenizer.encode((blank or "") + self.MARK, add_special_tokens=False).ids
        self.young, self.old = _Generation(), _Generation()
        vocabulary = tokenizer.get_vocab()
        self.edge, self.starts = np.zeros(1 + max(vocabulary.values(), default=0), bool), before == " "
        self.edge[[i for t, i in vocabulary.items() if (t.startswith(self.SPACE) if self.starts else t.endswith(self.WORD_END))]] = True

    def ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = chunks.dictionary_encode()
        slots = self._slots(coded.dictionary.to_pylist())
        return self.young.ids(slots[np.asarray(coded.indices)])

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """Of distinct chunks, all of which the young generation then has."""
        if len(self.young.slot) > self.most:
            self.old, self.young = self.young, _Generation()
        slots = self.young.slots(chunks)
        absent = np.flatnonzero(slots < 0)
        if absent.size:
            names = [chunks[i] for i in absent.tolist()]
            before = self.old.slots(names)
            known = before >= 0
            slots[absent[known]] = self.young.add([names[i] for i in np.flatnonzero(known).tolist()], *self.old.ids(before[known]))
            new = [names[i] for i in np.flatnonzero(~known).tolist()]
            if new:
                self.young.add(*self._encoded(new))
                slots[absent[~known]] = self.young.slots(new)
        return slots

    def _encoded(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks, which may come in another order, with their ids and numbers of ids."""
        clear = chunks if self.starts else [c for c in chunks if c.isalpha()]
        rest = [] if self.starts else [c for c in chunks if not c.isalpha()]
        parts = [self._by_edges(clear[i : i + _BLOCK]) for i in range(0, len(clear), _BLOCK)]
        parts += [self._together(rest[i : i + _BLOCK]) for i in range(0, len(rest), _BLOCK)]
        return [*clear, *rest], *(np.concatenate([p[i] for p in parts]) for i in range(2))

    def _by_edges(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.blank is None or not self.edge.any():
            return self._together(chunks)
        text = "".join(self.before + c for c in chunks) if self.starts else self.blank.join(chunks)
        (encoded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        if edges.size != len(chunks):
            return self._together(chunks)
        return ids, np.diff(edges, append=ids.size) if self.starts else np.diff(edges, prepend=-1)

    def _apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([self.before + c[self.skip :] for c in chunks], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.blank is None or any(self.MARK in c for c in chunks):
            return self._apart(chunks)
        between = f"{self.blank}{self.MARK}"
        text = "".join(f"{self.before or self.blank}{c}{between}" for c in chunks)
        (encoded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark[-1])
        if marks.size != len(chunks):
            return self._apart(chunks)
        k = len(self.mark)
        keep = np.ones(ids.size, bool)
        for i in range(k):
            keep[marks - i] = False
        return ids[keep], np.diff(marks, prepend=-1) - k


class ChunkEncoder:
    """`most` chunks are kept, and as many that were kept before."""

    def __init__(self, path: str, split: str, most: int = 250_000):
        from tokenizers import Tokenizer

        if split not in ("space", "blank", "word", "none"):
            raise ValueError(f"no such split: {split}")
        self.tokenizer, self.split = Tokenizer.from_file(path), split
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        if split in ("blank", "word"):
            self.bare = _Cache(self.tokenizer, "", most, " ")
        else:
            self.bare = _Cache(self.tokenizer, "", most // 8)
            self.spaced = _Cache(self.tokenizer, " ", most, " ")
            self.glued = _Cache(self.tokenizer, "", most // 8, skip=len(_GLUE))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as uint32, and each text's number of ids. A null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds, size, begin = [0], 0, texts.offset
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, begin * 8)
        for i in range(len(texts)):
            size += int(ends[i + 1] - ends[i])
            if size > _SLICE_BYTES:
                bounds.append(i + 1)
                size = 0
        if bounds[-1] < len(texts):
            bounds.append(len(texts))
        parts = [self._encode(texts.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
        pa.default_memory_pool().release_unused()
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.split == "none":
            return self._apart(texts.to_pylist(), lambda text: [text])
        if self.split in ("blank", "word"):
            lists = pc.ascii_split_whitespace(texts if self.split == "blank" else pc.replace_substring_regex(texts, _WORD_ENDS, r"\1 \2"))
            ids, lengths = self.bare.ids(lists.flatten())
            return ids, _sums(lengths, _offsets(lists))
        odd = np.asarray(pc.match_substring_regex(texts, _ODD_ARROW))
        plain = texts.filter(pa.array(~odd))
        ids, counts = self._spaced(plain) if len(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not odd.any():
            return ids, counts
        more, more_counts = self._apart(
            texts.filter(pa.array(odd)).to_pylist(), lambda t: [t] if _IS_RARE.search(t) else _CUT.split(t)
        )
        both = np.zeros(len(texts), np.int64)
        both[~odd], both[odd] = counts, more_counts
        of = np.repeat(odd, both)
        out = np.empty(int(both.sum()), np.uint32)
        out[~of], out[of] = ids, more
        return out, both

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _WORD_ENDS, rf"\1 {_GLUE}\2"), " ")
        flat, offsets = lists.flatten(), _offsets(lists)
        glued = np.asarray(pc.starts_with(flat, _GLUE)).astype(bool)
        kind = np.where(glued, 2, 1)
        kind[offsets[:-1]] = 0  # the first of a text has no space before it either
        lengths, found = np.empty(len(flat), np.int64), []
        for k, cache in enumerate((self.bare, self.spaced, self.glued)):
            ids, lengths[kind == k] = cache.ids(flat.filter(pa.array(kind == k)))
            found.append(ids)
        of = np.repeat(kind.astype(np.int8), lengths)
        out = np.empty(of.size, np.uint32)
        for k, ids in enumerate(found):
            out[of == k] = ids
        return out, _sums(lengths, offsets)

    def _apart(self, texts: list[str], cut) -> tuple[np.ndarray, np.ndarray]:
        lists = [cut(t) for t in texts]
        ids, lengths = self.bare.ids(pa.array([c for x in lists for c in x], pa.large_string()))
        return ids, _sums(lengths, np.cumsum([0, *map(len, lists)]))


def _offsets(lists: pa.Array) -> np.ndarray:
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return offsets - offsets[0]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, split: str) -> ChunkEncoder:
    """One for each tokenizer in a worker process; reused by later tasks."""
    if (path, split) not in _encoders:
        _encoders[path, split] = ChunkEncoder(path, split)
    return _encoders[path, split]


def gathered(batches: Iterator[pa.RecordBatch], most: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold `most` bytes: looking chunks up costs time for each call too."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0]
