"""Language-model scores by deleted interpolation.

P3(w | u v) = a ML(w | u v) + (1 - a) P2(w | v), P2 in the same way from P1(w), and P1 from one share for each known
type and one for all unknown ones. Trigrams, bigrams and unigrams are maximum-likelihood estimates of the training
rows. The weights a depend on the order and on the bucket of the context's frequency (powers of two); they are
learned from the lowest order up by expectation-maximisation on a fold deleted from the counts: the EM sees the
training rows without that fold as counts and the fold as held-out text. `score` is by one model, with the counts of all
training rows; `deleted_score` is by the same weights and the counts without the scored row's own, as if a training
row were held out, so it tells what the rest of the corpus makes of it. Each row is a sequence from two start marks to an end token.

Texts become chunks of word hashes once, written to the shared folder. A chunk sends its n-grams with their counts
to hash buckets, as sorted arrays: single words, and pairs of words with the words before them, so that a bucket
adds up trigrams and their pairs at once. The bucket answers what other chunks add to each count. There are as many
buckets as the corpus needs for each to be small, and a task holds one at a time. So a frequent n-gram moves one
entry a chunk, and nothing about single n-grams reaches the driver: it gets four sums, and for each order a
histogram whose bins (context bucket, log likelihood ratio in 64ths of a bit) are bounded by the numbers' range and
hold mean ratios. Words and pairs are told apart by 48 bits, the words before a pair by 24 more: of n different words
or pairs about one in 2^49 / n shares its counts with another, of n words before one pair one in 2^25 / n.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import DOCUMENTS, cut, pick, read
from quoin.llm.lookup import Lookup

HELD, DEV, MAIN = 0, 1, 2
END, START = np.uint64(0x9E3779B97F4A), np.uint64(0xC2B2AE3D27D4)  # fixed values, no word's hash but by chance
CHUNKS = "chunk bigint, tokens bigint, doc_ids binary, valid binary, fold binary, n_words binary, hashes binary, codes binary"
COUNTS = "part int, bucket bigint, chunk bigint, ord bigint, keys binary, sizes binary, befores binary, main binary, dev binary"
TOTALS = "key bigint, ord bigint, bucket bigint, main binary, dev binary, n_main bigint, n_dev bigint, v_main bigint, v_all bigint"
SUMS = -1  # the key of sums over all n-grams of a bucket


@dataclass(frozen=True)
class Interpolation:
    folds: int = 10
    held_fold: int = 0
    dev_fold: int = 1
    buckets: int = 48
    rounds: int = 200
    chunk_bytes: int = 5 << 20
    task_bytes: int = 12 << 20  # counts that one task is to read, at about eight bytes a token
    base_add: float = 0.1


def fold_of(doc_id: int | None, p: Interpolation) -> int:
    """By crc32 of the id as text; a null id counts as an empty one."""
    k = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % p.folds
    return HELD if k == p.held_fold else DEV if k == p.dev_fold else MAIN


def _pack(values: np.ndarray) -> bytes:
    """Byte k of all values, then byte k + 1, compressed: the high bytes of small numbers are runs of zeros."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


KEY_BITS, BEFORE_BITS = {1: 48, 2: 48}, 24
ODD = np.uint64(0x9FB21C651E98DF25)  # a fixed multiplier


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * ODD + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` of each value: hashes, which no compression makes smaller."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize)[:, : bits // 8]).tobytes()


def _unpack_low(raw: bytes, bits: int, kind) -> np.ndarray:
    kept = np.frombuffer(raw, np.uint8).reshape(-1, bits // 8)
    return np.ascontiguousarray(np.pad(kept, ((0, 0), (0, np.dtype(kind).itemsize - bits // 8)))).view(kind).reshape(-1)


def chunks(docs: DataFrame, p: Interpolation) -> DataFrame:
    """Documents as arrays of word codes with the hashes of the words; a chunk is about chunk_bytes of text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        part, seq = TaskContext.get().partitionId(), 0
        for ids, texts in _groups(batches, p.chunk_bytes):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
            word = np.asarray(pc.not_equal(flat, "")).astype(bool)
            before = np.concatenate([[0], np.cumsum(word)])
            offsets = before[offsets - offsets[0]]
            coded = flat.filter(pa.array(word)).dictionary_encode()
            hashes = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)) >> np.uint64(64 - KEY_BITS[1])
            row = {
                "chunk": (part << 24) + seq,
                "tokens": int(offsets[-1]) + len(ids),
                "doc_ids": np.array([0 if i is None else i for i in ids], np.int64).tobytes(),
                "valid": np.array([i is not None for i in ids], np.uint8).tobytes(),
                "fold": np.array([fold_of(i, p) for i in ids], np.uint8).tobytes(),
                "n_words": np.diff(offsets).astype(np.int64).tobytes(),
                "hashes": _pack_low(hashes, KEY_BITS[1]),
                "codes": _pack(np.asarray(coded.indices).astype(np.uint32)),
            }
            seq += 1
            yield pa.RecordBatch.from_pylist([row])

    return cut(pick(docs, DOCUMENTS).mapInArrow(build, CHUNKS))


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, pa.Array]]:
    """doc_ids and texts of rows in a row, of at most `most` bytes but for one larger row."""
    ids: list = []
    parts: list[pa.Array] = []
    held = 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        names, sizes, begin = batch.column(0).to_pylist(), pc.binary_length(texts).to_pylist(), 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                parts.append(texts.slice(begin, i - begin))
                ids += names[begin:i]
                if ids:
                    yield ids, pa.concat_arrays(parts)
                ids, parts, held, begin = [], [], 0, i
            held += size
        parts.append(texts.slice(begin))
        ids += names[begin:]
    if ids:
        yield ids, pa.concat_arrays(parts)


class Chunk:
    """A chunk's sequences: `token` indexes `hash`, whose last two are the end and the start."""

    def __init__(self, row: dict):
        self.doc_ids, self.valid = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["valid"], np.uint8)
        self.fold, n = np.frombuffer(row["fold"], np.uint8), np.frombuffer(row["n_words"], np.int64)
        self.hash = np.concatenate([_unpack_low(row["hashes"], KEY_BITS[1], np.uint64), [END, START]])
        self.end, self.start = self.hash.size - 2, self.hash.size - 1
        codes = _unpack(row["codes"], np.uint32)
        self.n_tokens = n + 1
        lasts = np.cumsum(self.n_tokens) - 1
        self.firsts = lasts - n
        is_last = np.zeros(int(self.n_tokens.sum()), bool)
        is_last[lasts] = True
        self.token = np.empty(is_last.size, np.int32)
        self.token[is_last], self.token[~is_last] = self.end, codes
        self.of = np.repeat(self.fold, self.n_tokens)
        self.row = np.repeat(np.arange(n.size, dtype=np.int32), self.n_tokens)

    def own(self, place: np.ndarray) -> np.ndarray:
        """How often each token's n-gram, given by its place, comes in its row; 0 in held-out rows, which count
        nowhere."""
        _, at, each = np.unique(self.row.astype(np.int64) << 32 | place, return_inverse=True, return_counts=True)
        out = each.astype(np.int32)[at]
        out[self.of == HELD] = 0
        return out

    def before(self, of: np.ndarray, first) -> np.ndarray:
        """Of each token what `of` holds for the one before it, and `first` at a sequence's start."""
        out = np.concatenate([of[:1], of[:-1]])
        out[self.firsts] = first
        return out

    def _counts(self, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(place[self.of == f], minlength=size) for f in (MAIN, DEV))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the key's place for each token, and counts in both folds."""
        order = np.argsort(self.hash[:-1])
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        at = place[self.token]
        return self.hash[order], at, *self._counts(at, order.size)

    def trigrams(self) -> Trigrams:
        context = self.before(self.token, self.start)
        pair = _mixed(self.hash[context], self.hash[self.token]) >> np.uint64(64 - KEY_BITS[2])
        keys, at = np.unique(pair, return_inverse=True)
        word = self.hash[self.before(context, self.start)]
        word = _mixed(word, keys[at]) >> np.uint64(64 - BEFORE_BITS)
        found, place = np.unique(at.astype(np.uint64) << np.uint64(32) | word, return_inverse=True)
        sizes = np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=keys.size)
        return Trigrams(keys, at, sizes, found.astype(np.uint32), place, *self._counts(place, found.size))


@dataclass
class Trigrams:
    """`keys`: distinct pairs in order; `at`: each token's pair (with the word before it); `sizes`: how many entries
    a pair has. Entries are a pair and the word before it, in order: `befores`, each token's `place`, and counts."""

    keys: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    befores: np.ndarray
    place: np.ndarray
    main: np.ndarray
    dev: np.ndarray

    def pairs(self, counts: np.ndarray) -> np.ndarray:
        """Counts of entries added up by pair."""
        return np.add.reduceat(counts, np.cumsum(self.sizes) - self.sizes) if counts.size else counts


def _cuts(keys: np.ndarray, ord_: int, bits: int) -> list[int]:
    """Where each bucket's keys begin and end: buckets are the keys' highest bits."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS[ord_] - bits)
    return [0, *np.searchsorted(keys, edges).tolist(), keys.size]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


@dataclass(frozen=True)
class Counts:
    table: Lookup
    bits: int


def exchange(rows: DataFrame, p: Interpolation) -> Counts:
    """Counts out by n-gram, and back to each chunk what the other chunks add."""
    tokens = rows.agg(F.sum("tokens")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-8 * tokens // p.task_bytes))
    bits = max(4, (2 * parts - 1).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            keys, _, *both = chunk.words()
            three = chunk.trigrams()
            for ord_, ks, sizes in ((1, keys, np.ones(keys.size, np.uint32)), (2, three.keys, three.sizes.astype(np.uint32))):
                befores = three.befores if ord_ == 2 else np.zeros(0, np.uint32)
                main, dev = (x.astype(np.uint32) for x in (both if ord_ == 1 else (three.main, three.dev)))
                cuts, begins = _cuts(ks, ord_, bits), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                out = []
                for bucket, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if x < y:
                        a, b = begins[x], begins[y]
                        out.append(
                            {
                                "part": bucket * parts >> bits, "bucket": bucket, "chunk": row["chunk"], "ord": ord_, "keys": _pack_keys(ks[x:y]), "sizes": _pack(sizes[x:y]) if ord_ == 2 else None,
                                "befores": _pack_low(befores[a:b], BEFORE_BITS) if ord_ == 2 else None, "main": _pack(main[a:b]), "dev": _pack(dev[a:b]),
                            }
                        )
                if out:
                    yield pa.RecordBatch.from_pylist(out, _schema(COUNTS))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and (row["bucket"], row["ord"]) != (held[0]["bucket"], held[0]["ord"]):
                yield pa.RecordBatch.from_pylist(_answers(held), _schema(TOTALS))
                held = []
            held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(_answers(held), _schema(TOTALS))

    sent = rows.mapInArrow(send, COUNTS).repartitionById(parts, "part").sortWithinPartitions("bucket", "ord")
    return Counts(Lookup(sent.mapInArrow(total, TOTALS), parts), bits)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _answers(sent: list[dict]) -> list[dict]:
    """For rows of one bucket and order: what the other rows add to each row's entries, then to its pairs, where
    there is anything; and the bucket's sums."""
    ord_, bucket = sent[0]["ord"], sent[0]["bucket"]
    keys = [_unpack_keys(r["keys"]) for r in sent]
    n_keys, all_keys = [k.size for k in keys], np.concatenate(keys)
    distinct, at = np.unique(all_keys, return_inverse=True)
    main, dev = (np.concatenate([_unpack(r[c], np.uint32) for r in sent]).astype(np.int64) for c in ("main", "dev"))
    if ord_ == 1:
        levels, n_entries = [(at, distinct.size, main, dev, n_keys)], n_keys
    else:
        each = np.concatenate([_unpack(r["sizes"], np.uint32) for r in sent]).astype(np.int64)
        befores = [_unpack_low(r["befores"], BEFORE_BITS, np.uint32) for r in sent]
        n_entries = [b.size for b in befores]
        found, place = np.unique(np.repeat(at, each).astype(np.uint64) << np.uint64(32) | np.concatenate(befores), return_inverse=True)
        begins = np.cumsum(each) - each
        levels = [(place, found.size, main, dev, n_entries), (at, distinct.size, np.add.reduceat(main, begins), np.add.reduceat(dev, begins), n_keys)]
    nothing = dict.fromkeys(("n_main", "n_dev", "v_main", "v_all"), 0)
    out = [{"key": r["chunk"], "ord": ord_, "bucket": bucket, "main": [], "dev": [], **nothing} for r in sent]
    useful, totals = [False] * len(sent), {}
    for place, size, *own, lengths in levels:
        ends = np.cumsum(lengths).tolist()
        for name, mine in zip(("main", "dev"), own, strict=True):
            totals[name] = np.bincount(place, mine, size).astype(np.int64)
            others = totals[name][place] - mine
            for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                out[i][name].append(others[a:b])
                useful[i] |= bool(others[a:b].any())
    if ord_ == 1:
        seen = totals["main"], totals["main"] + totals["dev"]
        nothing = {"n_main": int(seen[0].sum()), "n_dev": int(totals["dev"].sum()), "v_main": int((seen[0] > 0).sum()), "v_all": int((seen[1] > 0).sum())}
    packed = [r | {c: _pack(np.concatenate(r[c])) for c in ("main", "dev")} for r, u in zip(out, useful, strict=True) if u]
    return [*packed, {"key": SUMS, "ord": ord_, "bucket": bucket, "main": None, "dev": None, **nothing}]


def _known(chunk: Chunk, counts: Counts, number: int, scored: bool) -> list[tuple[np.ndarray, ...]]:
    """For each token the counts over all chunks of the trigram, its context, the pair, its context, and the word:
    those of the main fold, or, to be `scored`, first of all training rows and then of all but its own."""
    keys, at1, main1, dev1 = chunk.words()
    three = chunk.trigrams()
    main2, dev2 = three.pairs(three.main), three.pairs(three.dev)
    cuts = {1: _cuts(keys, 1, counts.bits), 2: _cuts(three.keys, 2, counts.bits)}
    begins = np.concatenate([[0], np.cumsum(three.sizes)]).astype(np.int64)
    for r in counts.table.rows(number, ["ord", "bucket", "main", "dev"]):
        x, y = cuts[r["ord"]][r["bucket"] : r["bucket"] + 2]
        for own1, own2, own3, raw in ((main1, main2, three.main, r["main"]), (dev1, dev2, three.dev, r["dev"])):
            add = _unpack(raw, np.int64)
            if r["ord"] == 1:
                own1[x:y] += add
            else:
                a, b = begins[x], begins[y]
                own3[a:b] += add[: b - a]
                own2[x:y] += add[b - a :]
    c1, c2, c3 = (m + d if scored else m for m, d in ((main1, dev1), (main2, dev2), (three.main, three.dev)))
    word, pair, all_three = c1[at1], c2[three.at], c3[three.place]
    ends = word[chunk.token == chunk.end][:1]
    starts = ends[0] if ends.size else 0  # as many starts as ends
    out = all_three, chunk.before(pair, starts), pair, chunk.before(word, starts), word
    if not scored:
        return [out]
    own3, own2, own1 = chunk.own(three.place), chunk.own(three.at), chunk.own(at1)
    first = (chunk.fold != HELD).astype(np.int64)
    return [out, tuple(c - own for c, own in zip(out, (own3, chunk.before(own2, first), own2, chunk.before(own1, first), own1), strict=True))]


def _context_bucket(context: np.ndarray, p: Interpolation) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(np.float64))[1], p.buckets - 1)


def _estimate(count: np.ndarray, context: np.ndarray) -> np.ndarray:
    return np.divide(count, context, out=np.zeros(count.size), where=context > 0)


NEVER = -(1 << 20)
RARE, NO_CHANCE = 1024, 65535  # held-out estimates are kept as parts of a bit, in two bytes


def _as_bits(p: np.ndarray) -> np.ndarray:
    bits = np.rint(-RARE * np.log2(p, out=np.zeros(p.size), where=p > 0))
    return np.where(p > 0, np.minimum(bits, NO_CHANCE - 1), NO_CHANCE).astype(np.uint16)


def _from_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < NO_CHANCE, np.exp2(-bits.astype(np.float64) / RARE), 0.0)


HELD_OUT = "bucket3 binary, bucket2 binary, p3 binary, p2 binary, p1 binary"


def held_out(rows: DataFrame, counts: Counts, n: int, p: Interpolation) -> DataFrame:
    """The held-out tokens' context buckets and estimates of each order under the other training rows, as arrays."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            dev = chunk.of == DEV
            if dev.any():
                c3, context3, c2, context2, c1 = (x[dev] for x in _known(chunk, counts, row["chunk"], scored=False)[0])
                found = (_context_bucket(context3, p).astype(np.uint8), _context_bucket(context2, p).astype(np.uint8))
                found += tuple(map(_as_bits, (_estimate(c3, context3), _estimate(c2, context2), c1 / max(n, 1))))
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket3", "bucket2", "p3", "p2", "p1"), map(_pack, found), strict=True))])

    return cut(rows.mapInArrow(tokens, HELD_OUT))


def _mixture(weights: list[np.ndarray], p0: float, buckets: list[np.ndarray], estimates: list[np.ndarray]) -> np.ndarray:
    """From the lowest order up, as many as there are weights."""
    out = np.full(estimates[0].size, p0)
    for w, bucket, estimate in zip(weights, buckets, estimates, strict=False):
        out = w[bucket] * estimate + (1 - w[bucket]) * out
    return out


def histogram(held: DataFrame, order: int, weights: list[np.ndarray], p0: float) -> list:
    """Held-out tokens by context bucket and by how much likelier the order's own estimate is than the mixture below
    it, in 64ths of a bit: b, k (NEVER for no chance at all), n, and the sum of the ratios' logarithms."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            estimates = [_from_bits(_unpack(row[c], np.uint16)) for c in ("p1", "p2", "p3")]
            buckets = [np.zeros(estimates[0].size, np.uint8), *(_unpack(row[c], np.uint8) for c in ("bucket2", "bucket3"))]
            own = estimates[order - 1]
            ratio = np.log2(own / _mixture(weights, p0, buckets, estimates), out=np.zeros(own.size), where=own > 0)
            k = np.where(own > 0, np.rint(64 * ratio), NEVER).astype(np.int64)
            found, inverse, each = np.unique(buckets[order - 1].astype(np.int64) << 32 | (k - NEVER), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found >> 32), pa.array((found & 0xFFFFFFFF) + NEVER), pa.array(each), pa.array(np.bincount(inverse, ratio))], ["b", "k", "n", "r"])

    found = held.mapInArrow(bins, "b bigint, k bigint, n bigint, r double")
    return found.groupBy("b", "k").agg(F.sum("n").alias("n"), F.sum("r").alias("r")).collect()


def learn(found: list, order: int, p: Interpolation) -> np.ndarray:
    """The order's weight in each context bucket by expectation-maximisation, from rows (b, k, n, r). A bucket's
    weight leans on that of all buckets as by ten tokens, and this on a half as by one. Of orders with a context,
    bucket 0, a context without counts, has none."""
    out = np.full(p.buckets, 0.5)
    if found:
        b, k, n, r = (np.array([x[i] for x in found], np.float64) for i in range(4))
        ratio = np.where(k > NEVER, np.exp2(r / n), 0.0)

        def fit(at: np.ndarray, prior: float, strength: float) -> float:
            w = 0.5
            for _ in range(p.rounds):
                own = w * ratio[at]
                w = ((n[at] * own / (own + 1 - w)).sum() + strength * prior) / (n[at].sum() + strength)
                w = min(max(w, 1e-9), 1 - 1e-9)
            return w

        pooled = fit(np.ones(n.size, bool), 0.5, 1.0)
        out = np.array([fit(b == i, pooled, 10.0) for i in range(p.buckets)])
    if order > 1:
        out[0] = 0
    return out


def score(docs: DataFrame, p: Interpolation = Interpolation()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, deleted_score of every row. All but the
    last are by the counts of all training rows; deleted_score, of a training row, is by those of the others.

    Null texts count as empty: their only token is the end. Rows without id are held out, as crc32 of nothing is
    0. Repeated rows count as often as they come, and rows that repeat an id are scored each by its own text. A text
    of any length is counted whole, in one task. There are no ties to break. Without training rows all shares but
    the uniform one are worth nothing. An empty table gives no rows."""
    rows = chunks(docs, p)
    counts = exchange(rows, p)
    sums = docs.sparkSession.read.schema(TOTALS).parquet(counts.table.folder).filter(f"key = {SUMS} and ord = 1")
    sums = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_main", "n_dev", "v_main", "v_all"))).first()
    held, weights = held_out(rows, counts, sums.n_main, p), []
    for order in (1, 2, 3):
        weights.append(learn(histogram(held, order, weights, 1 / (sums.v_main + 1)), order, p))
    n, v = sums.n_main + sums.n_dev, sums.v_all

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row)
            whole, deleted = _known(chunk, counts, row["chunk"], scored=True)
            others = np.repeat(np.where(chunk.fold == HELD, n, n - chunk.n_tokens), chunk.n_tokens)
            models = []
            for (c3, context3, c2, context2, c1), of in ((whole, np.full(others.size, n)), (deleted, others)):
                buckets = [np.zeros(c1.size, np.uint8), _context_bucket(context2, p), _context_bucket(context3, p)]
                models.append(np.log10(_mixture(weights, 1 / (v + 1), buckets, [_estimate(c1, of), _estimate(c2, context2), _estimate(c3, context3)])))
            c1 = whole[-1]
            base = np.log10((c1 + p.base_add) / (n + p.base_add * (v + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.doc_ids, mask=chunk.valid == 0),
                    pa.array(chunk.fold == HELD),
                    pa.array(chunk.n_tokens),
                    pa.array(np.add.reduceat((c1 > 0).astype(np.int64), chunk.firsts)),
                    pa.array(np.full(chunk.fold.size, n, np.int64)),
                    pa.array(np.add.reduceat(base, chunk.firsts)),
                    *(pa.array(np.add.reduceat(model, chunk.firsts)) for model in models),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "deleted_score"],
            )

    return rows.mapInArrow(apply, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, deleted_score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
