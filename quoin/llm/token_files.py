"""Token ids in directly addressable codes, in binary files.

An id is cut into chunks of `bits` bits, the lowest first. Level 0 holds the first chunk of every id, level k
the chunk k of those ids that have one. A bitmap beside each level says which of its chunks go on in the next;
a rank directory (set bits before each block of 512) finds the place there. So token i is read with one probe a
level: no block is decoded.

File: magic "QDAC", version, bits, levels (u32 each), documents, tokens (u64 each); the documents' ids and
validity; the bounds of their tokens (u64); for each level its size (u64), its chunks, the bitmap and the
directory (u64). All little-endian; every part starts at a multiple of 8.

Tasks write files under names of their own to the shared folder and return what they wrote; that table is the
manifest. A file is read only if the manifest names it, so files of failed or repeated tasks are never seen.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.chunk_tokens import encoder, gathered
from quoin.llm.common import DOCUMENTS, cut, filesystem, pick, read, shared_dir

MAGIC = b"QDAC"
BLOCK = 512
MANIFEST = "bucket bigint, seq bigint, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def _dtype(bits: int) -> np.dtype:
    return np.dtype({8: "u1", 16: "<u2"}[bits])


def encode_levels(ids: np.ndarray, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level: chunks, continuation bitmap (little bit order), rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    mask = np.uint32((1 << bits) - 1)
    while True:
        more = rest > mask
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, more.size, BLOCK)) if more.size else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(((rest & mask).astype(_dtype(bits)), bitmap, directory))
        rest = rest[more] >> np.uint32(bits)
        if not rest.size:
            return levels


def to_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    levels = encode_levels(ids, bits)
    head = MAGIC + np.array([1, bits, len(levels)], "<u4").tobytes() + np.array([len(doc_ids), ids.size], "<u8").tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    valid = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()
    parts = [head, names, valid, bounds]
    for chunks, bitmap, directory in levels:
        parts += [np.array([chunks.size], "<u8").tobytes(), chunks.tobytes(), bitmap.tobytes(), directory.tobytes()]
    return b"".join(map(_pad, parts))


class TokenFile:
    """Random access to a file's bytes, which may be a memory map."""

    def __init__(self, raw):
        self.raw, self.at = memoryview(raw), 0
        if bytes(self.raw[:4]) != MAGIC:
            raise ValueError("no token file")
        version, self.bits, n_levels = np.frombuffer(self.raw, "<u4", 3, 4).tolist()
        if version != 1:
            raise ValueError(f"unknown version {version}")
        self.n_docs, self.n_tokens = np.frombuffer(self.raw, "<u8", 2, 16).tolist()
        self.at = 32
        names, valid = self._take("<i8", self.n_docs), self._take("u1", self.n_docs)
        self.doc_ids = [int(d) if v else None for d, v in zip(names, valid, strict=True)]
        self.bounds = self._take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take("<u8", 1)[0])
            self.levels.append((self._take(_dtype(self.bits), n), self._take("u1", -(-n // 8)), self._take("<u8", -(-n // BLOCK) + 1)))

    def _take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += -(-out.nbytes // 8) * 8
        return out

    def _rank(self, level: int, i: int) -> int:
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        bits = np.unpackbits(bitmap[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(directory[block]) + int(bits.sum())

    def token(self, i: int) -> int:
        value, shift = 0, 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(k, i), shift + self.bits
        raise ValueError("a continuation bit on the last level")

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1: one rank query a level, then a slice of it."""
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if a == b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].astype(bool)
            where = where[bits]
            a = self._rank(k, a)
            b, shift = a + where.size, shift + self.bits
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, split: str, end_id: int, bits: int = 8, file_tokens: int = 1 << 22, buckets: int | None = None) -> DataFrame:
    """Writes files of about `file_tokens` ids in ascending doc_id order (null first, equal ids by text) and
    returns the manifest. Buckets are ranges of doc_id with near equal row counts, from quantiles of that column."""
    docs = pick(docs, DOCUMENTS)
    spark = docs.sparkSession
    parts = buckets or max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select("doc_id").na.drop().approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)
    bounds = sorted({int(c) for c in cuts})
    bucket = F.lit(0)
    if bounds:
        at = F.array(*(F.lit(b).cast("bigint") for b in bounds))
        bucket = F.coalesce(F.size(F.filter(at, lambda b: b <= F.col("doc_id"))), F.lit(0))
    rows = docs.withColumn("bucket", bucket.cast("bigint")).repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer, split).encode
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        state = {"bucket": None, "seq": 0, "tokens": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                names = [d for h in held for d in h[0]]
                lengths, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                raw, path = to_bytes(names, lengths, ids, bits), f"{root}/{uuid.uuid4().hex}.qdac"
                with fs.open_output_stream(path, compression=None) as out:
                    out.write(raw)
                uri = f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"
                row = {"bucket": state["bucket"], "seq": state["seq"], "path": uri, "n_docs": len(names), "n_tokens": int(ids.size), "n_bytes": len(raw)}
                yield pa.RecordBatch.from_pylist([row])
                held.clear()
            state["seq"], state["tokens"] = state["seq"] + 1, 0

        for batch in gathered(batches):
            ids, n = encode_all(batch.column(1))
            lengths = n + 1
            ends = np.cumsum(lengths)
            whole = np.empty(int(ends[-1]) if n.size else 0, np.uint32)
            is_end = np.zeros(whole.size, bool)
            is_end[ends - 1] = True
            whole[is_end], whole[~is_end] = end_id, ids
            of, names = np.asarray(batch.column(2)), batch.column(0).to_pylist()
            i = 0
            while i < len(names):
                if of[i] != state["bucket"]:
                    yield from flush()
                    state["bucket"], state["seq"] = int(of[i]), 0
                begin = int(ends[i] - lengths[i])
                j = max(i + 1, int(np.searchsorted(ends, begin + file_tokens - state["tokens"], "right")))
                j = min(j, int(np.searchsorted(of, of[i], "right")))
                held.append((names[i:j], lengths[i:j], whole[begin : ends[j - 1]]))
                state["tokens"] += int(ends[j - 1]) - begin
                if state["tokens"] >= file_tokens or j < len(names):
                    yield from flush()
                i = j
        yield from flush()

    return cut(rows.mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. Their order and lengths give the
    start of each file; running totals go over the manifest alone, by bucket and then within it."""
    sums = manifest.groupBy("bucket").agg(F.sum("n_tokens").alias("_n"))
    over = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("bucket").alias("_b"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(bases, F.col("bucket") == F.col("_b"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    file = TokenFile(f.read_buffer())
                bounds, ids = (4 * file.bounds).tolist(), memoryview(file.tokens(0, file.n_tokens).astype("<u4").tobytes())
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(start + file.bounds[:-1]), pa.array(np.diff(file.bounds)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.select("path", (F.col("_base") + F.col("_inside")).cast("bigint").alias("start")).repartition(parts, "path").mapInArrow(
        load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty and hold the end id alone; a null doc_id comes first; rows that repeat an id go by
    their texts, and repeated rows are written as often as they come. A text of any length is encoded whole and lies
    in one file. An empty table gives no files and no rows."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens"
    manifest = write_token_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), "word", 2)
    return read_token_files(manifest)
