"""Calls that outlive their run, and documents that are uploaded."""

import json
import os

import pytest

from quoin import schemas
from quoin.operators import calls, store
from quoin.plans import ingest
from quoin.settings import Settings
from quoin.sources.ledger import Ledger
from quoin.streaming.ingest import ingest_uploads


def test_a_killed_run_repeats_no_call(spark, tmp_path):
    log, killed = tmp_path / "log", tmp_path / "killed"

    def model(messages):
        text = messages[-1]["content"]
        with log.open("a") as f:
            f.write(text)
        if text == "d" and not killed.exists():
            killed.touch()
            os._exit(1)  # the worker dies in the middle of a call
        if text == "f":
            raise calls.RateLimited
        return f'```json\n{{"x": "{text}é"}}```'

    table = spark.createDataFrame([(i, u, i) for i, u in enumerate("abcdefg")], "key bigint, user string, order int").repartition(3)
    ask = lambda system="s": calls.ask(table, calls.Providers((("p", model),)), system, lambda v: v["x"], "string", ledger=Ledger(f"file://{tmp_path}/answers")).orderBy("key").collect()
    with pytest.raises(Exception, match="exited unexpectedly|crashed|SparkException|EOF|Job aborted"):
        ask()
    assert log.read_text() == "abcd"
    got = ask()
    assert [(r.status, r.value) for r in got] == [("done", f"{c}é") for c in "abcde"] + [("quota", None)] * 2
    assert log.read_text() == "abcd" + "def"  # only the call that was cut off, and new ones
    assert [r.status for r in ask()] == ["done"] * 5 + ["quota"] * 2 and log.read_text() == "abcddeff"
    other = ask("another system prompt")
    assert log.read_text() == "abcddeff" + "abcdef" and other[0].provider == "p"


def test_answers_that_no_longer_pass_are_asked_again(tmp_path):
    ledger, p = Ledger(f"{tmp_path}/answers"), calls.Providers((("p", lambda m: '{"x": 2}'),))
    messages = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    ledger.put({"provider": "old", "text": '{"y": 1}'}, "s", "u")

    def check(v):
        if "x" not in v:
            raise ValueError("x")
        return v["x"]

    assert p.checked(messages, check, ledger=ledger).value == 2 and ledger.get("s", "u") == {"provider": "p", "text": '{"x": 2}'} and ledger.get("s", "v") is None
    assert not [n for n in os.listdir(f"{tmp_path}/answers/{os.listdir(f'{tmp_path}/answers')[0]}") if not n.endswith(".json")]


WORDS = "The Supreme Court held on Friday November that Article 21 protects privacy and bail was granted in 14 cases. " * 3


def spans(content):
    lines = json.loads(content)
    return [dict(zip([c.split()[0] for c in schemas.SPANS.split(", ") if c.split()[0] != "issue"], (1, n, 0, 0, t, s, 0, "Serif", 40.0, y, 500.0, y + 20), strict=True)) for n, (t, s, y) in enumerate(lines)]


def test_uploads_are_processed_once(spark, tmp_path):
    db = store.Store(spark, f"file://{tmp_path}/db")
    db.init()
    log, up = tmp_path / "log", tmp_path / "up"
    up.mkdir()

    def classify(_):
        with log.open("a") as f:
            f.write("c")
        return json.dumps({"items": [{"id": 0, "relevant": True, "category": "judgment", "exam_tags": [], "score": 0.9, "reason": "r"}]})

    def upload(name, day):
        (up / name).write_text(json.dumps([(f"CHENNAI, FRIDAY, NOVEMBER {day}, 2019", 8.0, 30.0), (f"Court protects the privacy {day}", 20.0, 60.0), (WORDS, 9.0, 100.0)]))

    def run(checkpoint):
        query = ingest_uploads(db, f"file://{up}", spans, lambda _: [{"page": 1, "width": 595.0, "height": 842.0}], ingest.Models({"c": classify, "e": lambda _: "no JSON"}),
                               Settings(provider_chain="e", classify_chain="c", embeddings_enabled=False, min_interval_sec=0.0), f"file://{tmp_path}/{checkpoint}")
        query.awaitTermination()
        return sorted(str(r.issue_date) for r in db.table("issues").collect()), log.read_text()

    upload("a.json", 8)
    assert run("checkpoint") == (["2019-11-08"], "c")
    upload("b.json", 15)
    assert run("checkpoint") == (["2019-11-08", "2019-11-15"], "cc")
    ids = sorted((r.id, r.headline) for r in db.table("articles").collect())
    assert run("checkpoint")[1] == "cc"
    assert run("new checkpoint") == (["2019-11-08", "2019-11-15"], "cc")  # all files again, as after a lost checkpoint
    assert sorted((r.id, r.headline) for r in db.table("articles").collect()) == ids
