"""Copy-on-write upsert, WARC archives and their index, divergence audit, against plain versions."""

import bisect
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quoin.llm import divergence, upsert, warc
from quoin.llm.common import filesystem, shared_dir

CLIENTS = "client_id bigint, master_id bigint, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id bigint, CLIENT_ID string, client_id bigint, seq bigint, op string, valid_at timestamp, source string, segment string, city string, balance double"


def crc(x):
    return zlib.crc32(str(x).encode())


def plain_upsert(clients, changes, columns):
    most = 1 + len(clients) // 700
    start = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [start[i : i + most] for i in range(0, len(start), most)]
    firsts, homes = [f[0]["client_id"] for f in files], [{r["client_id"]: dict(r) for r in f} for f in files]
    newest = {}
    for c in changes:
        place = tuple((x is not None, x if x is not None else 0) for x in (c["seq"], c["change_id"])) + tuple((c[v] is not None, c[v] if c[v] is not None else 0) for v in ("op", "source", "segment", "city", "balance"))
        if c["client_id"] is not None and (c["client_id"] not in newest or place > newest[c["client_id"]][0]):
            newest[c["client_id"]] = (place, c)
    for key, (_, c) in newest.items():
        i = max(0, bisect.bisect_right(firsts, key) - 1)
        h = crc(firsts[i]) % 12
        if h > 7:
            continue
        if c["op"] == "D" or (c["change_id"] is not None and crc(c["change_id"]) % 8 < h):
            homes[i].pop(key, None)
        else:
            row = homes[i].setdefault(key, dict.fromkeys(columns) | {"client_id": key})
            row.update({v: c[v] for v in ("source", "segment", "city", "balance")})
    out = []
    for before, home in zip(files, homes, strict=True):
        rows = [home[k] for k in sorted(home)]
        if rows == before:
            out.append((rows, False))
            continue
        k, at = -(-len(rows) // most), 0
        for j in range(k):
            size = len(rows) // k + (j < len(rows) % k)
            if out and out[-1][1] and len(out[-1][0]) + size <= most:
                out[-1] = (out[-1][0] + rows[at : at + size], True)
            else:
                out.append((rows[at : at + size], True))
            at += size
    cents = lambda r: 0 if r["balance"] is None else math.floor(100 * r["balance"] + 0.5)
    mark = lambda r: zlib.crc32("|".join(r[c] or "" for c in ("source", "segment", "city")).encode())
    return sorted((r[0]["client_id"], len(r), sum(map(cents, r)), sum(map(mark, r)), hashlib.sha256(",".join(str(x["client_id"]) for x in r).encode()).hexdigest(), ",".join(columns), new) for r, new in out)


def shop(n, seed):
    rng = random.Random(seed)
    value = lambda: (rng.choice(["web", "crm", None]), rng.choice(["retail", None, "x" * 3000]), rng.choice(["Ünhav", "", None]), rng.choice([None, 12.345, -0.005, 7.0]))
    clients = []
    for i in rng.sample(range(3 * n), n):
        source, segment, city, balance = value()
        clients.append(dict(zip([c.split()[0] for c in CLIENTS.split(", ")], (i, i, source, None, "n", None, city, None, segment, balance), strict=True)))
    changes = []
    for i in range(4 * n):
        key = rng.choice([rng.randrange(3 * n), rng.randrange(3 * n), 5, None, 10 * n + i])
        changes.append((rng.choice([i, i, None]), "no key", key, rng.choice([0, 1, 2, None]), rng.choice(["U", "I", "D", None]), None, *value()))
    return clients, changes + changes[:9]  # repeated rows


@pytest.mark.parametrize(("n", "seed"), [(800, 1), (1500, 2)])
def test_upsert_against_plain_version(spark, tmp_path, n, seed):
    clients, changes = shop(n, seed)
    spark.createDataFrame([tuple(c.values()) for c in clients], CLIENTS).repartition(3).write.parquet(f"{tmp_path}/clients.parquet")
    names = [c.split()[0] for c in CHANGES.split(", ")]
    frame = spark.createDataFrame([c[:1] + c[2:] for c in changes], CHANGES.replace("CLIENT_ID string, ", ""))
    frame.repartition(3).write.parquet(f"{tmp_path}/client_changes.parquet")
    got = upsert.op11_cow_upsert(spark, str(tmp_path)).collect()
    want = plain_upsert(clients, [dict(zip(names, c, strict=True)) for c in changes], list(clients[0]))
    assert sorted((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r["columns"], r.rewritten) for r in got) == want
    folder = os.path.dirname(got[0].path).removeprefix("file://")
    assert sorted(glob.glob(f"{folder}/*.parquet")) == sorted(r.path.removeprefix("file://") for r in got)
    assert all(pq.read_table(r.path.removeprefix("file://"))["client_id"].to_pylist() == sorted(pq.read_table(r.path.removeprefix("file://"))["client_id"].to_pylist()) for r in got)


def test_upsert_without_files_and_repeated_keys(spark):
    schema, decide = "k bigint, a string, K string", lambda first: upsert.F.when(upsert.F.col("op") == "D", "delete").otherwise("set")
    table = upsert.create(spark.createDataFrame([], schema), f"{shared_dir(spark)}/t", "k", 2)
    read = lambda: sorted(map(tuple, spark.read.parquet(table.folder).collect()), key=str)
    change = lambda rows: spark.createDataFrame(rows, "k bigint, seq bigint, op string, a string")
    assert table.schema.names == ["k", "a"] and upsert.files(table, spark) == []
    assert upsert.upsert(spark, table, change([(1, 1, "I", "x"), (1, 1, "I", "x"), (3, 1, "I", "y"), (2, 1, "D", None), (None, 9, "I", "z")]), ["seq"], ["a"], decide) == set()
    assert read() == [(1, "x"), (3, "y")]
    many = upsert.create(spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (None, "n"), (9, "i")], "k bigint, a string"), f"{shared_dir(spark)}/t", "k", 2)
    upsert.upsert(spark, many, change([(1, 1, "U", "all"), (9, 1, "U", "i")]), ["seq"], ["a"], decide)
    assert sorted(map(tuple, spark.read.parquet(many.folder).collect()), key=str) == [(1, "all"), (1, "all"), (1, "all"), (9, "i"), (None, "n")]
    upsert.upsert(spark, many, change([(1, 2, "D", None), (9, 2, "D", None)]), ["seq"], ["a"], decide)
    assert [tuple(r) for r in spark.read.schema("k bigint, a string").parquet(many.folder).collect()] == [(None, "n")]


def test_empty_shop(spark, tmp_path):
    spark.createDataFrame([], CLIENTS).write.parquet(f"{tmp_path}/clients.parquet")
    spark.createDataFrame([], CHANGES.replace("CLIENT_ID string, ", "")).write.parquet(f"{tmp_path}/client_changes.parquet")
    assert upsert.op11_cow_upsert(spark, str(tmp_path)).collect() == []


@given(st.lists(st.one_of(st.none(), st.integers(0, 40)), max_size=12), st.integers(1, 10))
@settings(max_examples=300, deadline=None)
def test_planned_files(sizes, most):
    out, empty = upsert.planned(sizes, most)
    assert sum(out) == sum(n or 0 for n in sizes) and all(0 < n <= most for n in out) and empty == sum(n == 0 for n in sizes)


def plain_warc(rows):
    first = {}
    for p, _, h in rows:
        if len(b := (h or "").encode()) >= 100:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b, p)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if f == p else "revisit", None if f == p else f))
    return sorted(out)


@pytest.fixture
def pages(spark, tmp_path):
    rng = random.Random(3)
    body = lambda i: rng.choice([None, "", "short", "ü" * 50, "x" * 99, "y" * 100, f"<p>{i % 9}</p>" * 40, f"{i} " * 30_000 if i % 50 == 0 else "a"])
    urls = ["http://www.B.example.com:80/x?b=2&a=1#t", "https://a.example.com/é y", None, "", "no url", "http://[bad", "http://same.example.com/"]
    rows = [(i, rng.choice(urls), body(i)) for i in rng.sample(range(10**6), 400)]
    spark.createDataFrame([("k", *r) for r in rows], "other string, page_id bigint, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path), rows


def test_warc_against_plain_version(spark, pages):
    got = warc.op12_warc(spark, pages[0]).collect()
    assert sorted(tuple(r)[:5] for r in got) == plain_warc(pages[1])
    got.sort(key=lambda r: r.history_no)
    assert [r.history_no for r in got] == list(range(len(got)))
    assert [(r.url_key, r.page_id) for r in got] == sorted((r.url_key, r.page_id) for r in got)


def test_archives_are_whole_and_merged_in_rounds(spark, pages):
    frame = spark.read.parquet(f"{pages[0]}/pages.parquet").select("page_id", upsert.F.coalesce("url", upsert.F.lit("")).alias("url"), upsert.F.coalesce("html", upsert.F.lit("")).alias("html"), (upsert.F.col("page_id") * 1).alias("at"))
    folder = shared_dir(spark)
    runs = warc.write_archives(frame, f"{folder}/archives", archive_bytes=20_000, run_rows=7)
    found = warc.history(warc.merge_runs(runs, f"{folder}/index", fan_in=3)).collect()
    assert runs.count() > 40 and len(found) == 400
    found.sort(key=lambda r: r.history_no)
    assert [(r.url_key, r["at"], r.row) for r in found] == sorted((r.url_key, r["at"], r.row) for r in found)
    seen = 0
    for path in {r.archive for r in found}:  # an archive is read from its start without the index
        fs, name = filesystem(path)
        raw = fs.open_input_file(name).read()
        while raw:
            unpacker = zlib.decompressobj(31)
            fields, http, payload = warc.parse(unpacker.decompress(raw))
            assert fields["warc-type"] == "response" or (not payload and fields["warc-profile"] == warc.PROFILE and re.match(r"<urn:page:\d+:\d+>", fields["warc-refers-to"]))
            raw, seen = unpacker.unused_data, seen + 1
    assert seen == 400


def test_pages_with_nulls_repeats_and_none(spark, tmp_path):
    rows = [(None, "u", "z" * 200), (None, "u", "z" * 200), (4, "u", "z" * 200), (4, "u", "z" * 200), (7, None, None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/a/pages.parquet")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.op12_warc(spark, f"{tmp_path}/a").collect()]
    assert sorted(got, key=str) == sorted([(None, "revisit", 4), (None, "revisit", 4), (4, "response", None), (4, "revisit", 4), (7, "response", None)], key=str)
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert warc.op12_warc(spark, f"{tmp_path}/b").collect() == []


@given(st.lists(st.lists(st.integers(0, 30), max_size=9), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree(lists):
    streams = [iter([(x, 0, i, "payload") for x in sorted(one)]) for i, one in enumerate(lists)]
    assert [r[0] for r in warc.LoserTree(streams)] == sorted(x for one in lists for x in one)


def test_url_keys():
    assert warc.url_key("https://www.B.Example.com:443/P/a?b=2&a=1#x") == "com,example,b)/p/a?a=1&b=2"
    assert warc.url_key("http://a.org:8080") == "org,a:8080)/" and warc.url_key("Not a URL") == "not a url" and warc.url_key("http://[x") == "http://[x"


def documents(rng, n):
    words = [f"w{a}{b}" for a in "abcdéf" for b in "xyz"] + ["Ünd", "THE", "the"]
    text = lambda: " 1,".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.choice([0, 3, 40, 400])))
    return [(i, rng.choice([text(), text(), text(), None]), rng.choice(["en", "de", None, "rare"] if i > 3 else ["one"]), rng.choice(["s1", "s2", "ü", None]), "x") for i in range(n)]


@pytest.mark.parametrize("k", [200, 3])
def test_divergence_against_sql(spark, tmp_path, k):
    rows = documents(random.Random(k), 150)
    rows += rows[:20]  # repeated rows
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, LANG2 string").repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    sql = divergence.OP13_SQL.replace("rank <= 200", f"rank <= {k}")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(sql).fetchall())
    clash = frame.toDF("doc_id", "text", "lang", "source", "LANG")
    assert sorted(map(tuple, divergence.audit_sources(clash, k=k).collect())) == want and len(want) > 40
    audit = divergence.Audit(frame)
    joined = divergence.source_pairs(audit, most_groups=0)
    assert sorted((r.lang, r.source, "pair", r["item"], r.value, r["rank"]) for r in joined.collect()) == [r for r in want if r[2] == "pair"]


def test_divergence_of_nothing(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    assert divergence.audit_sources(spark.createDataFrame([], schema)).collect() == []
    got = divergence.audit_sources(spark.createDataFrame([(1, "few words", "en", "a"), (2, None, "en", None)], schema)).collect()
    assert sorted(map(tuple, got)) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]
