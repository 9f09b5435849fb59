import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from quoin import schemas
from quoin.functions.similarity import token_set_ratio
from quoin.operators import calls, dedup, enrich, evaluate, grounding, prefilter, reports, search, store
from quoin.operators.layout import Layout
from quoin.plans import ingest
from quoin.settings import Settings

DAY = datetime.date(2019, 11, 8)
BODY = "The Supreme Court on Friday held that Article 21 protects privacy. Justice Rao said 14 petitions were heard. " * 3


# ---- duplicates ----
def grouped(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, headline string, body string, page_no int, issue_date date")
    return {r.id: r for r in dedup.group_duplicates(df, ["id"]).collect()}


def test_story_on_two_pages(spark):
    short = "SC upholds right to privacy in landmark ruling", "The Supreme Court upheld the right to privacy on Friday.", 1, DAY
    long = "SC upholds right to privacy in a landmark ruling", "The Supreme Court upheld the right to privacy on Friday. More follows here.", 13, DAY
    other = "Monsoon arrives early in Kerala", "Rain lashed the coast.", 2, DAY
    got = grouped(spark, [short, other, long])
    assert set(got) == {1, 2} and got[2].also_on_pages == [1] and got[1].also_on_pages == []
    assert len(grouped(spark, [short, (*short[:3], DAY + datetime.timedelta(1))])) == 2
    assert set(grouped(spark, [short, short, ("", None, 3, None), ("", "", 4, None)])) == {0, 2, 3}  # no words: like nothing


def plain_groups(rows):
    """One story after another, longest first: (headline, body, page, date) to the pages that join a kept one."""
    kept, pages = [], {}
    for i in sorted(range(len(rows)), key=lambda i: (-len(rows[i][1] or ""), i)):
        like = lambda k: rows[i][3] == rows[k][3] and all(token_set_ratio(a, b) >= 80 for a, b in ((rows[i][0], rows[k][0]), ((rows[i][1] or "")[:300], (rows[k][1] or "")[:300])))  # noqa: B023,E731
        to = next((k for k in kept if like(k)), None)
        if to is None:
            kept.append(i)
        pages.setdefault(i if to is None else to, []).extend([] if to is None else [rows[i][2]])
    return {k: sorted(pages[k]) for k in kept}


def test_groups_against_plain_rules(spark):
    rng = random.Random(11)
    some = "court privacy verdict bail rain monsoon coast election rates bank growth the of in and a".split()
    rows = []
    for i in range(260):
        if i % 3 and rows:
            head, body, _, day = rng.choice(rows)
            head, body = head.split(), body.split()
            for ws in (head, body):
                for _ in range(rng.choice([0, 0, 1, 2, 6])):
                    if ws:
                        ws[rng.randrange(len(ws))] = rng.choice([*some, "privacyx", "courts"])
            head, body = " ".join(head), " ".join(body[: rng.choice([None, None, 12])])
        else:
            head, body, day = " ".join(rng.choices(some, k=rng.randint(1, 9))), " ".join(rng.choices(some, k=rng.randint(0, 90))), rng.choice([DAY, DAY, DAY + datetime.timedelta(1), None])
        rows.append((head, body, rng.randint(1, 20), day))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, headline string, body string, page_no int, issue_date date").repartition(3)
    wanted = plain_groups(rows)
    assert 30 < len(wanted) < 200
    for block in (1024, 16):
        got = {r.id: r.also_on_pages for r in dedup.group_duplicates(df, ["id"], dedup.Duplicates(block=block)).collect()}
        assert got == wanted


# ---- prefilter ----
def gate(spark, headline, body, section=None, least=0.0):
    df = spark.createDataFrame([(headline, body, section)], "headline string, body string, section string")
    return prefilter.prefilter(df, prefilter.Rules(min_score=least)).first()


def test_prefilter(spark):
    legal = gate(spark, "Supreme Court grants bail", "The High Court order on section 480 was set aside.", least=2)
    assert legal.passed and legal.score == 2 + 1 + 2 + 1 + 2 + 2 and r"\bbail\b" in legal.hits
    assert not gate(spark, "India win the match", "A great innings.", "Sport", 2).passed
    assert not gate(spark, "Town fair opens", "Visitors came.", least=2).passed
    assert gate(spark, "Town fair opens", "Visitors came.").passed
    assert gate(spark, "Export tariff cut", "A trade deal was signed.", least=2).passed
    assert gate(spark, "Cyclone nears coast", "Flood alert.", least=2).score == 1.5 + 1.5 + 1
    junk = gate(spark, "The Crossword 123", "bail")
    assert not junk.passed and junk.score == 0 and junk.hits == []
    assert not gate(spark, "x", "supreme court", "SPORT").passed and gate(spark, "x", "supreme court bail", "SPORT").passed
    assert gate(spark, None, None).score == 0


@pytest.mark.parametrize("pattern", prefilter.STRONG + prefilter.WEAK)
def test_guards_are_safe(pattern):
    for literal in prefilter.guard(pattern):
        assert literal == literal.lower() and literal
    assert prefilter.guard(r"\bBNSS?\b") == ["bns"] and prefilter.guard("maoist|naxal") == ["maoist", "naxal"]
    assert prefilter.guard(r"trade (?:deal|war)") == ["trade "] and prefilter.guard(r"\bsection\s+\d+") == ["section"]


# ---- grounding ----
def checked(spark, strict=False, **change):
    data = {
        "summary": "14 petitions were heard", "key_points": ["privacy"], "case": None, "provisions": [("Article 21", "constitution")], "exam_relevance": "x", "event_date": None,
        "evidence": [("Article 21 protects privacy. Justice Rao said",)],
    } | change
    row = tuple(data[k] for k in ("summary", "key_points", "case", "provisions", "exam_relevance", "event_date", "evidence"))
    df = spark.createDataFrame([(1, BODY, row)], f"id int, body string, data {schemas.EXTRACTION}")
    return grounding.validate(df, strict_numbers=strict).first()


def test_grounded(spark):
    r = checked(spark)
    assert (r.status, r.warnings) == ("verified", [])


def test_invented_parts_are_dropped(spark):
    r = checked(spark, provisions=[("Section 999 of the Zeta Act", "section"), ("Article 21", "constitution")], case=("Foo v. Barbaz Qux", "Supreme Court", ["Rao", "Nobody Else"], "h"))
    assert r.status == "partial" and [p.name for p in r.data.provisions] == ["Article 21"]
    assert r.data.case.case_name is None and r.data.case.court == "Supreme Court" and r.data.case.bench == ["Rao"] and r.data.case.holding == "h"
    assert r.warnings[0].endswith("Section 999 of the Zeta Act") and len(r.warnings) == 3


def test_fake_quote_and_numbers(spark):
    r = checked(spark, evidence=[("completely fabricated words about bananas",)])
    assert r.status == "needs_review" and r.warnings == ["dropped 1 ungrounded quote(s)"]
    r = checked(spark, summary="over 97 petitions, 1,400 pages")
    assert r.status == "partial" and r.warnings == ["numbers in summary not found in article: 1400, 97"]


def test_one_wrong_digit(spark):
    assert checked(spark, provisions=[("Article 22", "constitution")]).status == "verified"  # 90 of 100: let through
    assert checked(spark, True, provisions=[("Article 22", "constitution")]).status == "partial"


def test_event_date(spark):
    assert checked(spark, event_date=DAY).data.event_date is None
    assert checked(spark, event_date=datetime.date(2019, 5, 1), summary="x").warnings == []


# ---- state ----
def tables(spark, dates):
    issues = [(i, d, "f", "s", "done", None, None) for i, d in enumerate(dates, 1)]
    articles = spark.createDataFrame([(i * 10, i, f"h{i}") for i in range(1, len(dates) + 1)], "id bigint, issue_id bigint, content_hash string")
    return {
        "issues": spark.createDataFrame(issues, schemas.ISSUES), "articles": articles,
        "extractions": articles.select(F.col("id").alias("article_id")), "feedback": articles.select(F.col("id").alias("article_id")),
    }


def test_retention(spark):
    t = tables(spark, [DAY + datetime.timedelta(n) for n in range(5)])
    victims = store.prune_victims(t["issues"], 3, protect=1)
    assert [r.id for r in victims.collect()] == [2]
    left = store.delete_issues(t, store.prune_victims(t["issues"], 3))
    assert {r.id for r in left["issues"].collect()} == {3, 4, 5}
    assert all({r[0] // 10 for r in left[n].collect()} == {3, 4, 5} for n in ("articles", "extractions", "feedback"))


def test_extraction_upsert_and_votes(spark):
    old = spark.createDataFrame([(1, "v1", [0.5], DAY), (2, "v1", None, DAY)], "article_id bigint, prompt_version string, embedding array<float>, created_at date")
    new = spark.createDataFrame([(1, "v2", None, None), (3, "v2", None, DAY)], "article_id bigint, prompt_version string, embedding array<float>, created_at date")
    got = {r.article_id: r for r in store.upsert_extractions(old, new).collect()}
    assert got[1].prompt_version == "v2" and got[1].embedding is None and got[1].created_at == DAY and set(got) == {1, 2, 3}
    votes = spark.createDataFrame([(1, 1, "n", None)], "article_id bigint, vote int, note string, created_at timestamp")
    empty = spark.createDataFrame([], schemas.FEEDBACK)
    assert store.save_feedback(empty, votes).first().id == 1
    with pytest.raises(Exception, match="vote must be"):
        store.save_feedback(empty, votes.withColumn("vote", F.lit(2))).collect()


def test_stale_versions(spark):
    a = spark.createDataFrame([(i, 1, True, 0.5) for i in range(1, 5)], "id bigint, issue_id bigint, relevant boolean, relevance_score double")
    e = spark.createDataFrame([(2, "v1"), (3, "v2"), (4, None)], "article_id bigint, prompt_version string")
    assert {r.id for r in store.pending_extract(a, e, "v2").collect()} == {1, 2}


def test_finish_issues(spark):
    i = tables(spark, [DAY, DAY + datetime.timedelta(1), DAY + datetime.timedelta(2)])["issues"]
    ended = spark.createDataFrame([(1, "partial", ""), (2, "done", "2 pages")], "id bigint, status string, note string")
    got = {r.id: (r.status, r.note) for r in store.finish_issues(i, ended).collect()}
    assert got == {1: ("partial", None), 2: ("done", "2 pages"), 3: ("done", None)}


def test_undated_and_repeated_dates(spark):
    issues = tables(spark, [DAY])["issues"]
    rows = [(DAY, "a.pdf", "1", None), (DAY, "b.pdf", "0", None), (DAY + datetime.timedelta(1), None, "2", None), (DAY + datetime.timedelta(1), "c.pdf", "3", None)]
    incoming = spark.createDataFrame(rows, "issue_date date, filename string, pdf_sha256 string, created_at timestamp")
    new, changed = store.upsert_issues(issues, incoming)
    assert sorted((r.id, r.issue_date, r.filename) for r in new.collect()) == [(1, DAY, "b.pdf"), (2, DAY + datetime.timedelta(1), "c.pdf")]
    assert [r.id for r in changed.collect()] == [1]
    undated = spark.createDataFrame([(None, "x.pdf", "1", None)], incoming.schema)
    with pytest.raises(Exception, match="no issue date for x.pdf"):
        store.upsert_issues(issues, undated)[0].collect()


def test_ids_go_on_by_block(spark):
    old = spark.createDataFrame([(7,)], "id bigint")
    new = spark.createDataFrame([(2, "b"), (1, "z"), (2, "a"), (None, "n")], "block bigint, name string")
    got = {r.name: r.id for r in store.numbered(new, old, F.col("block"), ["name"]).collect()}
    assert got == {"n": 8, "z": 9, "a": 10, "b": 11}


def test_store_writes_touched_parts_and_refuses_a_second_writer(spark, tmp_path):
    first = store.Store(spark, f"file://{tmp_path}/db")
    first.init()
    rows = spark.createDataFrame([(i, i % 3) for i in range(1, 10)], "id bigint, issue_id bigint")
    articles = first.table("articles").unionByName(rows, allowMissingColumns=True)
    first.commit({"articles": articles})
    before = dict(first.paths)
    first.commit({"articles": first.table("articles", [1]).filter("id > 1")}, [1, 5])
    changed = {part for (name, part), to in first.paths.items() if before.get((name, part)) != to}
    assert changed == {"1", "5"} and sorted(r.id for r in first.table("articles").collect()) == [2, 3, 4, 5, 6, 7, 8, 9]
    first.commit({"articles": first.table("articles", [2]).limit(0)}, [2])
    assert sorted(r.id for r in store.Store(spark, first.folder).table("articles").collect()) == [3, 4, 6, 7, 9]
    second = store.Store(spark, first.folder)
    second.refresh()
    second.refresh = lambda: None  # what it read before the other's change
    first.commit({"articles": first.table("articles", [0]).limit(0)}, [0])
    with pytest.raises(store.Conflict):
        second.commit({"articles": rows.limit(0)}, [1])


# ---- search ----
def ranks(spark, ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id bigint, rank int")


def test_fusion(spark):
    got = [r.id for r in search.fuse([ranks(spark, [1, 2, 3]), ranks(spark, [3, 4])], 3).orderBy("rank").collect()]
    assert got == [3, 1, 2]  # 2 and 4 have equal sums: the first list was seen first


def test_terms(spark):
    rows = spark.createDataFrame([(1, "Rising petitions and a petition"), (2, "Nothing"), (3, None)], "id bigint, search_text string")
    assert [(r.id, r.score) for r in search.term_rank(rows, "the petition").collect()] == [(1, 0.2)]
    assert search.term_rank(rows, "the of ?").count() == 0 and search.query_terms("") == []


def test_stems_in_both_forms(spark):
    rng = random.Random(3)
    some = ["petitions", "parties", "boxes", "bus", "analysis", "glass", "rising", "bring", "red", "stopped", "falling", "buzzing", "tied", "ing", "sing", "running", "ss", "crashes", "s", "", "laws", "bias", "planned", "agreed", "ies", "dies"]
    some += ["".join(rng.choices("aeistdnglzy", k=rng.randint(1, 6))) + rng.choice(["", "s", "es", "ies", "ing", "ed", "nned", "lling"]) for _ in range(500)]
    df = spark.createDataFrame([(w,) for w in some], "w string").select("w", search.stem_of(F.col("w")).alias("s"))
    assert [(r.w, r.s) for r in df.collect()] == [(w, search.stem(w)) for w in some]


def test_search_without_vectors(spark):
    rows = spark.createDataFrame([(1, "a bail order", None), (2, "other", [1.0, 0.0])], "id bigint, search_text string, embedding array<float>")
    assert [r.id for r in search.hybrid_search(rows, "bail").collect()] == [1]
    assert [r.id for r in search.hybrid_search(rows, "bail", lambda _: None).collect()] == [1]
    assert {r.id for r in search.hybrid_search(rows, "bail", lambda _: [[1.0, 0.0]]).collect()} == {1, 2}
    cards = rows.selectExpr("*", "current_date() issue_date", "1 page_no", "'h' headline", "named_struct('summary', 's', 'key_points', array('k', 'l')) data")
    assert search.answer("q", search.hybrid_search(cards, "of"), lambda s, x: x) == search.NO_HITS
    assert search.answer("q", search.hybrid_search(cards, "bail"), lambda s, x: f"{s} {x}").endswith("p.1) h\ns\n- k\n- l")


# ---- evaluation ----
def test_scores(spark):
    a = spark.createDataFrame([("a", True, True), ("b", True, None), ("c", False, True), ("a", None, False)], "content_hash string, prefilter_passed boolean, relevant boolean")
    labels = spark.createDataFrame([("a", " 1", 0, 0), ("b", "1", 0, 1), ("c", "1", 0, 2), ("c", "0", 1, 0), ("d", "", 1, 1)], "content_hash string, human string, file_no int, row_no int")
    r = evaluate.scores(a, evaluate.gold(labels)).first()
    assert (r.labelled, r.positives, r.tp, r.fp, r.fn) == (4, 3, 1, 1, 2)
    assert r.prefilter_recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(0.4)


# ---- enrichment ----
def item(n, **change):
    return {"id": n, "relevant": True, "category": "other", "exam_tags": [], "score": 0.9, "reason": "r"} | change


def test_lax_values():
    ok = enrich.check_batch({"items": [item("1", relevant="yes", score="0.5", extra=1), item(True, relevant=0)]})
    assert [(x["id"], x["relevant"], x["score"]) for x in ok] == [(1, True, 0.5), (1, False, 0.9)]
    for bad in (item(1.5), item(1, relevant="maybe"), item(1, score=1.01), item(1, category="Other"), item(1, exam_tags=["upsc", "x"]), item(1, reason="x" * 301)):
        with pytest.raises(ValueError):
            enrich.check_batch({"items": [item(0), bad]})
    assert enrich.as_date("2019-11-08T00:00:00", "d") == DAY
    with pytest.raises(ValueError):
        enrich.as_date("08/11/2019", "d")


def test_fallback_and_quota():
    def limited(_):
        raise calls.RateLimited

    def broken(_):
        raise OSError

    asked = []

    def repaired(messages):
        asked.append(len(messages))
        return "```json\n{\"items\": []}\n```" if len(messages) > 2 else "{"

    m = [{"role": "system", "content": ""}, {"role": "user", "content": ""}]
    got = calls.Providers((("a", limited), ("b", repaired))).checked(m, enrich.check_batch)
    assert (got.status, got.value, got.provider) == ("done", [], "b") and asked == [2, 4] and len(m) == 2
    assert calls.Providers((("b", repaired),), repairs=0).checked(m, enrich.check_batch).status == "failed"
    assert calls.Providers((("a", limited),)).text(m).status == "quota" and calls.Providers(()).text(m).status == "failed"
    failed = calls.Providers((("a", limited), ("b", broken))).text(m)
    assert failed.status == "failed" and "b: broken OSError" in failed.error
    assert enrich.reply(calls.Providers((("c", lambda m: m[1]["content"] + "!"),)), "s", "hi").value == "hi!"


def test_chain_by_name():
    known = {"x": str, "y": repr}
    assert [n for n, _ in calls.Providers.named(" y ,x,", known).chain] == ["y", "x"] and [n for n, _ in calls.Providers.named("", known, 4.0).chain] == ["x", "y"]
    with pytest.raises(KeyError, match="z"):
        calls.Providers.named("x, z", known)


def test_calls_are_spaced():
    now, slept = [100.0], []
    limiter = calls.Limiter(4.0, lambda: now[0], slept.append)
    for provider, at in (("a", 100.0), ("b", 101.0), ("a", 101.0), ("a", 110.0), ("a", 110.0)):
        now[0] = at
        limiter.rest(provider)
    assert slept == [3.0, 4.0]


def test_used_up_quota_ends_a_lane(spark):
    import tempfile

    log = tempfile.NamedTemporaryFile(delete=False).name

    def some(messages):
        with open(log, "a") as f:
            f.write(messages[-1]["content"])
        if messages[-1]["content"] == "c":
            raise calls.RateLimited
        return "{}"

    table = spark.createDataFrame([(i, u, i) for i, u in enumerate("abcdef")], "key bigint, user string, order int").repartition(4)
    got = calls.ask(table, calls.Providers((("p", some),)), "s", lambda x: None, "string").toPandas()
    assert got.sort_values("key")["status"].tolist() == ["done", "done", *["quota"] * 4] and open(log).read() == "abc"


@pytest.mark.parametrize("text", ['{"a": 1}', ' ```json\n{"a": 1}\n``` ', '```\n{"a": 1}```', '```json {"a": 1}'])
def test_fences(spark, text):
    assert json.loads(calls.unfenced(text)) == {"a": 1}
    assert spark.createDataFrame([(text,)], "t string").select(calls.parsed(F.col("t"), "a int").alias("x")).first().x.a == 1


def test_forms_say_what_checks_let_through():
    assert enrich.BATCH_FORM["properties"]["items"]["items"]["required"] == ["id", "relevant", "category", "score", "reason"]
    assert set(enrich.EXTRACTION_FORM["required"]) == {"summary", "key_points", "exam_relevance", "evidence"}
    assert "maxLength" in calls.instructed("s", enrich.EXTRACTION_FORM)


def test_classify_batches(spark):
    rows = spark.createDataFrame([(i, 1, i, f"h{i}", "b") for i in range(1, 11)], "id bigint, issue_id bigint, seq int, headline string, body string")

    def some(messages):
        if "[7]" not in messages[-1]["content"]:
            raise calls.RateLimited
        return json.dumps({"items": [item(0, score=0.3), item(1), item(1, category="economy"), item(99)]})

    got = {r.id: r for r in enrich.classify(rows, calls.Providers((("p", some),)), "s").collect()}
    assert got[1].status == "done" and not got[1].relevant and got[2].category == "economy" and got[3].status == "failed" and got[9].status == "quota"


def test_embed_leaves_failures_out(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "article_id bigint, search_text string").coalesce(1)
    encode = lambda texts: [[1.0]] * len(texts) if "t0" in texts else None
    assert {r.article_id for r in enrich.embed(rows, encode, 1, 2, lanes=1).collect()} == {0, 1}


# ---- the whole ingest ----
def test_ingest_twice(spark, tmp_path):
    db = store.Store(spark, f"file://{tmp_path}/db")
    db.init()
    words = "The Supreme Court held on Friday November that Article 21 protects privacy and bail was granted in 14 cases. " * 3
    blocks = spark.createDataFrame(
        [("f", 1, 0, 40.0, 30.0, 500.0, 45.0, "CHENNAI, FRIDAY, NOVEMBER 8, 2019", 8.0, False, 33), ("f", 1, 1, 40.0, 60.0, 500.0, 82.0, "Court protects the privacy", 20.0, False, 26), ("f", 1, 2, 40.0, 100.0, 540.0, 300.0, words, 9.0, False, len(words))],
        schemas.BLOCKS,
    )
    pages = spark.createDataFrame([("f", 1, 595.0, 842.0), ("f", 2, 595.0, 842.0)], schemas.PAGES)
    files = spark.createDataFrame([("f", "f.pdf", "sha1")], "issue string, filename string, pdf_sha256 string")
    log = tmp_path / "calls"

    def classify(_):
        with log.open("a") as f:
            f.write("c")
        return json.dumps({"items": [item(0)]})

    def extract(_):
        with log.open("a") as f:
            f.write("e")
        return json.dumps({"summary": "14 cases", "key_points": [], "exam_relevance": "x", "evidence": [{"quote": "Article 21 protects privacy and bail"}]})

    models = ingest.Models({"other": lambda _: "", "c": classify, "e": extract}, {"none": lambda _: None, "v": lambda texts: [[0.1234567, 1.0]] * len(texts)})
    settings, steps = Settings(provider_chain="e", classify_chain="c", embed_model="v", embed_dim=2, min_interval_sec=0.0), []
    for _ in range(2):
        stats = ingest.process(db, files, pages, blocks, models, settings, progress=lambda *x: steps.append(x)).first()
        assert (stats.issue_date, stats.status, stats.articles, stats.passed_prefilter, stats.relevant, stats.extracted) == (DAY, "done", 1, 1, 1, 1)
    assert log.read_text() == "ce"  # the second run finds nothing left to ask
    assert steps == [(n, k, k) for k in (1, 0) for n in ("segmented", "prefilter", "classify", "extract", "embed")][:5] + [("segmented", 1, 1), *((n, 0, 0) for n in ("prefilter", "classify", "extract", "embed"))]
    assert db.table("issues").first().note == "1 page(s) without text, which would need OCR: 2"
    e = db.table("extractions").first()
    assert e.validation_status == "verified" and e.embedding == pytest.approx([0.123457, 1.0])
    card = reports.brief(search.cards(db.table("articles"), db.table("issues"), db.table("extractions"))).first()
    assert card.seq == 1 and card.headline == "Court protects the privacy"
    changed = files.withColumn("pdf_sha256", F.lit("sha2"))
    assert ingest.process(db, changed, pages, blocks, models, settings).first().extracted == 1
    assert log.read_text() == "ce" and Layout().min_words == 20
    strict = Settings(provider_chain="e", min_interval_sec=0.0, prefilter_min_score=99.0, embeddings_enabled=False)
    again = files.withColumn("pdf_sha256", F.lit("sha3"))
    assert ingest.process(db, again, pages, blocks, models, strict).first().passed_prefilter == 0 and log.read_text() == "ce"
    with pytest.raises(ValueError, match="no issue date for g.pdf"):
        ingest.process(db, spark.createDataFrame([("g", "g.pdf", "x")], files.schema), pages, blocks, models, settings)
    assert db.table("issues").count() == 1


def test_used_up_quota_is_noted(spark, tmp_path):
    db = store.Store(spark, f"file://{tmp_path}/db")
    db.init()

    def limited(_):
        raise calls.RateLimited

    words = "The Supreme Court held that privacy and bail matter. " * 5
    blocks = spark.createDataFrame([("f", 1, 0, 40.0, 60.0, 500.0, 82.0, "Court protects the privacy", 20.0, False, 26), ("f", 1, 1, 40.0, 100.0, 540.0, 300.0, words, 9.0, False, len(words))], schemas.BLOCKS)
    pages = spark.createDataFrame([("f", p, 595.0, 842.0) for p in (1, 2, 3)], schemas.PAGES)
    files = spark.createDataFrame([("f", "f.pdf", "s", DAY)], "issue string, filename string, pdf_sha256 string, issue_date date")
    stats = ingest.process(db, files, pages, blocks, ingest.Models({"p": limited}), Settings(min_interval_sec=0.0)).first()
    assert stats.status == "partial" and stats.note == f"2 page(s) without text, which would need OCR: 2, 3; {ingest.QUOTA_NOTE}"
    assert db.table("articles").first().classify_status == "pending"


def test_labels_round_trip(spark, tmp_path):
    from quoin.sources import files

    export = spark.createDataFrame([(DAY, "h1", 1, 'a "quoted", head', "line\nbreak", "")], "issue_date date, content_hash string, page_no int, headline string, snippet string, human string")
    files.write_labels(export.withColumn("human", F.lit("1")), f"{tmp_path}/labels")
    got = files.gold_labels(spark, [f"{tmp_path}/labels/issue_date=2019-11-08"]).first()
    assert (got.content_hash, got.human) == ("h1", "1")


def test_new_files_once(spark, tmp_path):
    from quoin.streaming.ingest import ingest_new_files

    seen = []
    for n in range(2):
        spark.range(n + 1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest_new_files(spark, f"{tmp_path}/in", "id bigint", lambda df, _: seen.append(df.count()), f"{tmp_path}/cp").awaitTermination()
    assert sum(seen) == 3


def test_files_and_decoder(spark, tmp_path):
    from quoin.sources import files

    (tmp_path / "a.bin").write_bytes(b"hello")
    got = files.files(spark, str(tmp_path), "*.bin")
    assert got.first().sha256 == __import__("hashlib").sha256(b"hello").hexdigest()
    decode = lambda raw: [{"page": 1, "block": 0, "line": 0, "span": 0, "text": raw.decode(), "size": 9.0, "flags": 0, "font": "f", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}]
    assert files.decoded(got, decode).first().text == "hello"


DECODER = """
import json

def spans(raw):
    return [{"page": 1, "block": n, "line": 0, "span": 0, "text": t, "size": s, "flags": 0, "font": "f", "x0": 40.0, "y0": y, "x1": 500.0, "y1": y + 22.0}
            for n, (y, s, t) in enumerate(json.loads(raw))]

def pages(raw):
    return [{"page": n, "width": 595.0, "height": 842.0} for n in (1, 2)]

def models():
    from quoin.plans.ingest import Models
    answer = {"items": [{"id": 0, "relevant": False, "category": "other", "score": 0.1, "reason": "r"}]}
    return Models({"p": lambda messages: json.dumps(answer)})
"""


def test_documents_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from quoin.__main__ import main

    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "plain_decoder.py").write_text(DECODER)
    monkeypatch.syspath_prepend(str(tmp_path / "code"))
    spark.sparkContext.addPyFile(str(tmp_path / "code" / "plain_decoder.py"))
    (tmp_path / "in").mkdir()
    words = "The court held that privacy and bail matter to all of us. " * 4
    (tmp_path / "in" / "paper_2020-03-02.json").write_text(json.dumps([[60.0, 20.0, "Court protects the privacy"], [100.0, 9.0, words]]))
    db = f"file://{tmp_path}/db"
    main(["--db", db, "init"])
    main(["--db", db, "ingest", "--documents", f"{tmp_path}/in", "--decoder", "plain_decoder", "--models", "plain_decoder:models"])
    assert "2020-03-02" in capsys.readouterr().out
    t = store.Store(spark, db)
    assert [(r.headline, r.classify_status, r.relevant) for r in t.table("articles").collect()] == [("Court protects the privacy", "done", False)]
    assert t.table("issues").first().note.endswith("OCR: 2")
    with pytest.raises(SystemExit):
        main(["--db", db, "ingest", "--documents", "x", "--models", "plain_decoder:models"])


def test_command_line(spark, tmp_path, capsys):
    from quoin.__main__ import main

    db = f"file://{tmp_path}/db"
    main(["--db", db, "init"])
    t = store.Store(spark, db)
    t.commit({"issues": tables(spark, [DAY, DAY + datetime.timedelta(1)])["issues"]})
    main(["--db", db, "delete", "2019-11-08"])
    assert [r.id for r in t.table("issues").collect()] == [2] and t.table("articles").count() == 0
    main(["--db", db, "stats"])
    assert "2019-11-09" in capsys.readouterr().out
