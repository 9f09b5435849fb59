"""Best-fit packing of documents into training sequences by vector bin packing.

An item is a vector: its tokens, 1 document, its attention cost (tokens squared). A sequence has a capacity in
each of the three. Items go in by decreasing length; of the open sequences that hold an item under every
constraint, the one with the smallest weighted norm of what would stay free (`policy="norm"`), or the largest
weighted dot product of item and free capacity (`policy="dot"`), gets it.

Equal lengths are equal vectors, so the plan needs the number of pieces of each length only: at most `tokens`
numbers, whatever the input's size. It is made on the driver for whole runs of equal sequences at once and gives
each (length, rank) its sequence and offset. The rank among pieces of a length is counted in two levels, so a
length that a third of all pieces have is no hot group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.chunk_tokens import encoder, gathered
from quoin.llm.common import DOCUMENTS, cut, pick, read


@dataclass(frozen=True)
class Packing:
    """Capacities of a sequence and the choice among open ones. With the defaults only the tokens bind: no
    2048 tokens hold more than 2048 documents or cost more than 2048 squared."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    policy: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    tokenizer: str = ""
    split: str = "space"
    end_id: int = 0

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], np.float64)


def plan(counts: dict[int, int], packing: Packing) -> dict[str, np.ndarray]:
    """Runs of equal placements, by (length, rank): the pieces of `length` with ranks from `rank` on go `each`
    to a sequence, to sequences from `sequence` on, at `offset` and then one after another."""
    cap, w = packing.capacity(), np.asarray(packing.weights)
    begin, number, free, fill = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3)), np.zeros(0, np.int64))
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        item, left, rank = np.array([length, 1, length * length], np.float64), counts[length], 0
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        while left:
            fits = (free >= item).all(axis=1)
            if fits.any():
                if packing.policy == "norm":
                    score = -((w * ((free - item) / cap) ** 2).sum(axis=1))
                else:
                    score = (w * (item / cap) * (free / cap)).sum(axis=1)
                k = int(np.argmax(np.where(fits, score, -np.inf)))
                each = int((free[k] // item).min()) if packing.policy == "norm" else 1
                first, there, room, at = int(begin[k]), int(number[k]), free[k].copy(), int(fill[k])
                keep = np.arange(begin.size) != k
                begin, number, free, fill = begin[keep], number[keep], free[keep], fill[keep]
            else:
                each = int((cap // item).min())
                first, there, room, at = opened, -(-left // each), cap, 0
                opened += there
            take = min(left, each * there)
            out.append((length, rank, first, each, at))
            full, rest = divmod(take, each)
            runs = [(first, full, each), (first + full, 1 if rest else 0, rest), (first + full + bool(rest), there - full - bool(rest), 0)]
            runs = [r for r in runs if r[1]]
            begin = np.concatenate([begin, [r[0] for r in runs]])
            number = np.concatenate([number, [r[1] for r in runs]])
            free = np.concatenate([free, [room - r[2] * item for r in runs]])
            fill = np.concatenate([fill, [at + r[2] * length for r in runs]])
            open_ = free[:, 0] > 0
            begin, number, free, fill = begin[open_], number[open_], free[open_], fill[open_]
            left -= take
            rank += take
    columns = np.array(out, np.int64).reshape(-1, 5)
    order = np.lexsort((columns[:, 1], columns[:, 0]))
    return dict(zip(("length", "rank", "sequence", "each", "offset"), columns[order].T, strict=True))


def pieces(docs: DataFrame, packing: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _part, _rank. A text's ids, then the end id; a document longer
    than a sequence is cut into full ones, the first piece being what is left over. _rank counts the pieces of
    the same length before it in its task, _part."""
    most = packing.tokens

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        encode_all = encoder(packing.tokenizer, packing.split).encode
        for batch in gathered(batches):
            ids, n = encode_all(batch.column(1))
            total = n + 1
            k = -(-total // most)  # pieces of each document
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(row.size) - np.repeat(np.cumsum(k) - k, k)
            first = total - (k - 1) * most
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * most)
            length = np.where(piece == 0, first[row], most)
            ends = np.cumsum(n)
            data, end = memoryview(ids.astype("<u4").tobytes()), np.array([packing.end_id], "<u4").tobytes()
            at = (ends - n)[row] + start
            is_last = piece == k[row] - 1
            crc = [zlib.crc32(data[4 * a : 4 * (a + m - z)]) for a, m, z in zip(at.tolist(), length.tolist(), is_last.tolist(), strict=True)]
            crc = [zlib.crc32(end, c) if z else c for c, z in zip(crc, is_last.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            new = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if row.size else np.zeros(0, np.int64)
            runs = np.diff(np.r_[new, row.size])
            rank = np.empty(row.size, np.int64)
            rank[order] = np.arange(row.size) - np.repeat(new, runs) + seen[sorted_]
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(row.size, part)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"],
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _part bigint, _rank bigint"
    return pick(docs, DOCUMENTS).mapInArrow(encode, schema)


def pack(docs: DataFrame, packing: Packing) -> DataFrame:
    """One row per piece of every document, with sequence_id and offset.

    Null and empty texts have the end id alone. A null doc_id is kept. Repeated rows are packed as often as they
    come. A text of any length is encoded whole, in one task. Pieces of equal length are alike to the plan and take
    their places by task and order of reading; of equally good sequences the one opened first is taken. An empty
    table gives no rows. Pieces are written to the shared folder once, so the
    tokenizer runs once and ranks hold whatever is lost later."""
    cuts = cut(pieces(docs, packing))
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    runs = plan(counts, packing)
    by_part = cuts.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = cuts.join(bases, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    width = 1 + max((int(x) for x in counts.values()), default=0)
    key = runs["length"] * width + runs["rank"]  # ranks lie under width: sorted by (length, rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            k = np.searchsorted(key, length * width + rank, "right") - 1
            inside = rank - runs["rank"][k]
            each = runs["each"][k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(runs["sequence"][k] + inside // each), pa.array(runs["offset"][k] + inside % each * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("rank")).mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def production() -> Packing:
    import public_tokenizers

    return Packing(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), production())
