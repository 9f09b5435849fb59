"""Pages as WARC archives, and their captures as one index in the order of URL key and time.

Tasks write archives: a gzip member a record, so a record is read by its offset alone. Beside them each task writes its
captures as runs, sorted before they are written. Runs are merged from outside memory: the keys are cut into ranges, and
a task merges up to `fan_in` runs of a range through a loser tree, a batch of each run at a time, in as many rounds
as the number of runs asks for. What comes out is the captures' history: all URLs in order, each URL's captures by time.

A payload that an earlier record holds whole is not stored again: its record is a revisit that names the other. Which
rows are copies is worked out on narrow rows (digest, row number), and told to the writing tasks by row number; so
`pages` is read twice and must give its rows alike both times, as a table does.

Files have names of their own, and only those that a written manifest names are ever read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import cut, filesystem, pick, read, shared_dir
from quoin.llm.lookup import Lookup

PAGES = {"page_id": "bigint", "url": "string", "html": "string"}
RUNS = "path string, n bigint, keys array<struct<url_key: string, at: bigint, row: bigint>>"
CAPTURE = pa.schema([("url_key", pa.string()), ("at", pa.int64()), ("row", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RUN = pa.schema([("path", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.struct(list(CAPTURE)[:3])))])
HISTORY = "history_no bigint, url_key string, at bigint, row bigint, page_id bigint, archive string, offset bigint, length bigint"
MOST_RANGES = 20_000  # broadcast: a key each

# Fixed value: the profile that the format's standard names for revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Hosts from the top domain down, then path and sorted query, in lower case; without scheme, www, default port
    and fragment. What is no URL is taken whole, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    tail = "" if port in (None, 80, 443) else f":{port}"
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{','.join(reversed(host.split('.')))}{tail}){parts.path or '/'}{'?' + query if query else ''}".lower()


def record(kind: str, name: str, url: str, at: int, digest: str, payload: bytes, earlier: dict | None = None) -> bytes:
    """A record's bytes. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if earlier else http + payload
    line = lambda text: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)
    day = lambda t: datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {day(at)}", f"WARC-Target-URI: {line(url) or 'about:blank'}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if earlier:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{earlier['name']}>", f"WARC-Refers-To-Target-URI: {line(earlier['url']) or 'about:blank'}", f"WARC-Refers-To-Date: {day(earlier['at'])}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 5) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's header lines by name in lower case, its HTTP header, its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("no whole record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def record_name(page_id: int | None, row: int) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}:{row}"


def copies(pages: DataFrame, least_bytes: int) -> Lookup:
    """By partition of the row numbers: the places of rows whose payload an earlier row has, and that row's id, number,
    URL and time. Of equal payloads the row with the smallest page_id (null last), then row number, keeps it."""
    narrow = pages.select("row", "page_id", "at", "url", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")).filter(F.col("n") >= least_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url", "at"))
    firsts = narrow.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = narrow.select("row", "digest").join(firsts, "digest").filter("row <> first.row")
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    rows = later.select(part.alias("key"), place.alias("place"), "first.page_id", F.col("first.row").alias("of"), "first.url", "first.at")
    files = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Lookup(rows, files)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, archive_bytes: int = 1 << 30, run_rows: int = 100_000) -> DataFrame:
    """pages: page_id, url, html, at (seconds of the capture). Writes archives of about `archive_bytes` and runs of at
    most `run_rows` captures each; gives the manifest of the runs, with evenly spaced keys of each."""
    pages = pages.withColumn("row", F.monotonically_increasing_id())
    known = copies(pages, least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, place, captures, earlier = None, 0, [], None
        name = ""
        for batch in batches:
            for page_id, url, html, at, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if earlier is None:
                    earlier = {r["place"]: r for r in known.rows(row >> 33, ["place", "page_id", "of", "url", "at"])}
                if out is None:
                    name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.encode()
                first = earlier.get(row & (1 << 33) - 1)
                named = first and {"name": record_name(first["page_id"], first["of"]), "url": first["url"], "at": first["at"]}
                raw = member(record("revisit" if first else "response", record_name(page_id, row), url, at, hashlib.sha256(payload).hexdigest(), payload, named))
                out.write(raw)
                captures.append((url_key(url), at, row, page_id, f"{folder}/{name}", place, len(raw)))
                place += len(raw)
                if place >= archive_bytes:
                    out.close()
                    out = None
                if len(captures) >= run_rows:
                    yield _run(fs, root, folder, captures)
                    captures = []
        if out is not None:
            out.close()
        if captures:
            yield _run(fs, root, folder, captures)

    return cut(pages.select("page_id", "url", "html", "at", "row").mapInArrow(write, RUNS))


def _run(fs, root: str, folder: str, captures: list[tuple]) -> pa.RecordBatch:
    """A sorted run, written in small row groups so that a range of keys is read without the rest."""
    captures.sort(key=lambda c: c[:3])
    writer = _Writer(fs, root, folder)
    for i in range(0, len(captures), 4096):
        writer.write(captures[i : i + 4096])
    writer.close()
    keys = [dict(zip(("url_key", "at", "row"), c[:3], strict=True)) for c in captures[:: max(1, len(captures) // 64)]]
    return pa.RecordBatch.from_pylist([{"path": writer.path, "n": len(captures), "keys": keys}], RUN)


class _Writer:
    def __init__(self, fs, root: str, folder: str):
        import pyarrow.parquet as pq

        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.run"
        self.path, self.n = f"{folder}/{name}", 0
        self.raw = fs.open_output_stream(f"{root}/{name}", compression=None)
        self.file = pq.ParquetWriter(self.raw, CAPTURE)

    def write(self, rows: list[tuple]) -> None:
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CAPTURE.types, strict=True)], schema=CAPTURE))
        self.n += len(rows)

    def close(self) -> None:
        self.file.close()
        self.raw.close()


def run_rows(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """A run's captures from `low` up to before `high`, a row group at a time; groups outside are not read."""
    import pyarrow.parquet as pq

    fs, name = filesystem(path)
    with fs.open_input_file(name) as raw:
        file = pq.ParquetFile(raw)
        for g in range(file.num_row_groups):
            known = file.metadata.row_group(g).column(0).statistics
            if known is not None and known.has_min_max:
                if low and known.max < low[0]:
                    continue
                if high and known.min > high[0]:
                    return
            for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns), strict=True):
                if low and row[:3] < low:
                    continue
                if high and row[:3] >= high:
                    return
                yield row


class LoserTree:
    """Merges sorted streams. Node 0 holds the winner, every other node the loser of the match below it, so the next
    row costs one match a level."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.heads = [next(s, None) for s in streams]
        k = max(1, len(streams))
        self.heads += [None] * (k - len(streams))
        winners = [0] * k + list(range(k))
        self.nodes = [0] * k
        for i in range(k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            winners[i], self.nodes[i] = (a, b) if self._first(a, b) else (b, a)
        self.nodes[0] = winners[1] if k > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Ended streams come last; equal keys go by the streams' order."""
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[:3], a) < (y[:3], b))

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.heads)
        while (head := self.heads[winner := self.nodes[0]]) is not None:
            yield head
            self.heads[winner] = next(self.streams[winner], None)
            node = (winner + k) // 2
            while node:
                if self._first(self.nodes[node], winner):
                    self.nodes[node], winner = winner, self.nodes[node]
                node //= 2
            self.nodes[0] = winner


def merge_runs(runs: DataFrame, folder: str, fan_in: int = 64, range_rows: int = 1_000_000) -> DataFrame:
    """range and path of the files that hold all captures of the runs in order, with the number `base` of the first."""
    spark = runs.sparkSession
    n, count = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(parts, -(-n // range_rows)))
    sample = runs.select(F.explode("keys").alias("k")).select("k.*").orderBy(F.xxhash64("url_key", "at", "row")).limit(MOST_RANGES).collect()
    keys = sorted((r.url_key, r["at"], r.row) for r in sample)  # only cuts the work: any bounds give the same order
    held = spark.sparkContext.broadcast(sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else [])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = held.value
        for batch in batches:
            for no, paths, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = (None, None) if whole else (bounds[no - 1] if no else None, bounds[no] if no < len(bounds) else None)
                fs, root = filesystem(folder)
                writer, block = None, []
                for row in LoserTree([run_rows(p, low, high) for p in sorted(paths)]):
                    writer = writer or _Writer(fs, root, folder)
                    block.append(row)
                    if len(block) == 4096:
                        writer.write(block)
                        block = []
                if writer:
                    if block:
                        writer.write(block)
                    writer.close()
                    yield pa.RecordBatch.from_pylist([{"no": no, "path": writer.path, "n": writer.n}])

    groups = max(1, -(-count // fan_in))
    dealt = runs.select(F.pmod(F.xxhash64("path"), F.lit(groups)).alias("g"), "path").groupBy("g").agg(F.collect_list("path").alias("paths"))  # about fan_in each
    todo = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(len(held.value)))).alias("no"), "paths", F.lit(False).alias("whole"))
    tasks = lambda df: df.repartition(max(parts, min(4 * parts, groups)), F.xxhash64("no", "paths"))
    merged = cut(tasks(todo).mapInArrow(merge, "no bigint, path string, n bigint"))
    while groups > 1:  # the files of a range, again at most about fan_in at a time
        groups = -(-groups // fan_in)
        dealt = merged.select("no", F.pmod(F.xxhash64("path"), F.lit(groups)).alias("g"), "path").groupBy("no", "g").agg(F.collect_list("path").alias("paths"))
        merged = cut(tasks(dealt.select("no", "paths", F.lit(True).alias("whole"))).mapInArrow(merge, "no bigint, path string, n bigint"))
    before = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)  # MOST_RANGES rows at most
    return merged.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def history(index: DataFrame) -> DataFrame:
    """All captures with their number in the global order, from the merged files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["history_no", *CAPTURE.names]
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block: list[tuple] = []
                for row in run_rows(path):
                    block.append((base, *row))
                    base += 1
                    if len(block) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), [pa.int64(), *CAPTURE.types], strict=True)], names)
                        block = []
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), [pa.int64(), *CAPTURE.types], strict=True)], names)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("path", "base").repartition(parts, "path").mapInArrow(load, HISTORY)


def read_records(captures: DataFrame, stretch: int = 1 << 24) -> DataFrame:
    """The records of these captures, from the archives, a stretch of an archive at a time and forward only."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = captures.withColumn("_part", F.floor(F.col("offset") / stretch)).repartition(parts, "archive", "_part").sortWithinPartitions("archive", "offset")
    schema = "history_no bigint, url_key string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, opened = None, None
        for batch in batches:
            out = []
            for no, key, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != opened:
                    if raw:
                        raw.close()
                    fs, name = filesystem(archive)
                    raw, opened = fs.open_input_file(name), archive
                raw.seek(offset)
                fields, http, payload = parse(zlib.decompress(raw.read(length), 31))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{archive}, {offset}: the payload is damaged")
                size = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1])
                ids = [None if x in ("", "none") else int(x) for x in (fields.get(f, "::").split(":")[2] for f in ("warc-record-id", "warc-refers-to"))]
                out.append((no, key, ids[0], size, digest, kind, ids[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], [x.split()[0] for x in schema.split(", ")]) if out else pa.RecordBatch.from_pylist([])
        if raw:
            raw.close()

    return near.select("history_no", "url_key", "archive", "offset", "length").mapInArrow(load, schema)


START = 1_704_067_200  # the first second of 2024


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the table has no times, so a page is captured as many seconds after the start of 2024 as its page_id
    says (modulo 10^9; null: none).

    Null html is empty and null urls are empty (about:blank in the record); a page of any length is one record. Of
    repeated rows, and of rows that share the smallest page_id, the first read is the response; null page_ids come
    last, and a revisit of one refers to null. Only page_id, url and html are looked at, of columns with one name the
    first. An empty table gives no archives and no rows."""
    pages = pick(read(spark, sf_dir, "pages"), PAGES)
    at = F.lit(START) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), at.alias("at"))
    folder = shared_dir(spark)
    index = merge_runs(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    return read_records(history(index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_no")
