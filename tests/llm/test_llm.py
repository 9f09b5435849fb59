import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quoin.llm import chunk_tokens, decontamination, license_scan, license_texts, lm_scoring, media, packing, preferences, sharding, simhash, token_files, toxicity

SCHEMA = "Doc_Id string, doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


def rows(texts):
    """(id, text) with columns that clash in case."""
    return [("x", i, t, "en", "s", None if t is None else len(t), "y") for i, t in texts]


def ids_of(df):
    """Of a frame whose column names clash in case."""
    return [r[0] for r in df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select("c1").collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words(rng, 300)
    out = [(i, words(rng, rng.randrange(1, 120))) for i in range(10, 60)]
    out += [(100 + i, base) for i in range(5)]  # exact copies
    for i in range(8):  # near copies: one word in each
        w = base.split()
        w[i * 30] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "É x\x00 y　z  <|endoftext|> it's"), (304, words(rng, 20_000)), (None, "no id"), (10, out[0][1]), (10, out[0][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- tokens, 5 and 9 ----
@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t '　\x1c.1Σ<|>,sİ\u0301\u0338-\x01\x02", max_size=30), max_size=8))
def test_chunks_give_the_tokenizers_ids(some):
    for name, split in (("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "blank"), ("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "none")):
        mine = chunk_tokens.encoder(public_tokenizers.path(name), split)
        ids, lengths = mine.encode(pa.array(some, pa.string()))
        plain = [e.ids for e in mine.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert lengths.tolist() == [len(x) for x in plain] and ids.tolist() == [i for x in plain for i in x]


def plain_ids(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids + [end] for e in t.encode_batch([x or "" for _, x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, none, texts):
    got = packing.pack(docs, packing.production()).toPandas()
    wanted = Counter()
    total = 0
    for (i, _), ids in zip(texts, plain_ids("byte_bpe_50k.json", texts, 0), strict=True):
        total += len(ids)
        k = -(-len(ids) // 2048)
        first = len(ids) - (k - 1) * 2048
        for p in range(k):
            a = 0 if p == 0 else first + (p - 1) * 2048
            b = first if p == 0 else a + 2048
            wanted[-1 if i is None else i, p, a, b - a, crc(ids[a:b])] += 1
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == wanted
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-total // 2048) + 1
    assert packing.pack(none, packing.production()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.integers(1600, 2500))
def test_plan_keeps_every_capacity(counts, policy, documents, cost):
    p = packing.Packing(tokens=64, documents=documents, cost=cost, policy=policy)
    runs = packing.plan(counts, p)
    filled: dict[int, list[tuple[int, int]]] = {}
    placed = Counter()
    rows_ = list(zip(*(runs[k].tolist() for k in ("length", "rank", "sequence", "each", "offset")), strict=True))
    for n, (length, rank, sequence, each, offset) in enumerate(rows_):
        last = rows_[n + 1][1] if n + 1 < len(rows_) and rows_[n + 1][0] == length else counts[length]
        for r in range(rank, last):
            filled.setdefault(sequence + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
            placed[length] += 1
    assert placed == Counter(counts)
    for s in filled.values():
        s.sort()
        assert [a for a, _ in s] == [sum(m for _, m in s[:i]) for i in range(len(s))]
        assert sum(m for _, m in s) <= 64 and len(s) <= documents and sum(m * m for _, m in s) <= cost


def test_token_files(spark, docs, none, texts, tmp_path):
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), "blank", 2, file_tokens=500, buckets=5)
    got = sorted(map(tuple, token_files.read_token_files(manifest).fillna(-1, ["doc_id"]).collect()), key=lambda r: r[1])
    order = sorted(zip(texts, plain_ids("word_bpe_49k.json", texts, 2), strict=True), key=lambda x: (-1 if x[0][0] is None else x[0][0], x[0][1] or ""))
    at = 0
    for (doc, start, n, c), ((i, _), ids) in zip(got, order, strict=True):
        assert (doc, start, n, c) == (-1 if i is None else i, at, len(ids), crc(ids))
        at += len(ids)
    assert manifest.count() > 5
    empty = token_files.write_token_files(none, f"file://{tmp_path}/e", public_tokenizers.path("word_bpe_49k.json"), "blank", 2)
    assert empty.count() == 0 and token_files.read_token_files(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 49407, 2**32 - 1]), max_size=1500), st.sampled_from([8, 16]))
def test_any_token_without_decoding(ids, bits):
    file = token_files.TokenFile(token_files.to_bytes([7], np.array([len(ids)]), np.array(ids, np.uint32), bits))
    for i in list(range(0, len(ids), 97)) + [len(ids) - 1] * bool(ids):
        assert file.token(i) == ids[i]
    a = len(ids) // 3
    assert file.tokens(a, len(ids)).tolist() == ids[a:] and file.doc_ids == [7]


# ---- 4 ----
def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: (id, fingerprint); the least id of each row's component, over rows."""
    to = list(range(len(pairs)))

    def top(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, (_, f) in enumerate(pairs):
        for j in range(i):
            if (f ^ pairs[j][1]).bit_count() <= 4:
                to[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(pairs))]


@pytest.mark.parametrize("split", [1 << 15, 3])
def test_simhash(docs, none, texts, split):
    pairs = [(i, plain_fingerprint(t)) for i, t in texts]
    wanted = Counter((d, f"{f:016x}", c) for (d, f), c in zip(pairs, plain_components(pairs), strict=True))
    p = simhash.SimHash(split=split)
    assert Counter(map(tuple, simhash.near_duplicates(docs, p).collect())) == wanted
    assert simhash.near_duplicates(none, p).count() == 0
    kept = simhash.one_of_each(docs, p)
    least = set(plain_components(pairs))  # the ids are apart but for copies, and one component has none
    assert sorted(ids_of(kept), key=str) == sorted(least, key=str) and None in least
    assert kept.columns == docs.columns


def test_hot_key_and_chain(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:  # a chain of clouds, all near each other
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(40) ^ 1 << rng.randrange(40))
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    frame = spark.createDataFrame(signed, "fp bigint")
    for split in (1 << 15, 50):
        p = simhash.SimHash(split=split, hub=3)  # many nodes are hubs, dealt by salts
        got = {r.fp: r.least.first for r in simhash.components(frame.withColumn("first", F.col("fp")), simhash.links(frame, p), p).collect()}
        groups = plain_components([(s[0], f) for s, f in zip(signed, fps, strict=True)])
        assert got == {s[0]: c for s, c in zip(signed, groups, strict=True)}


def test_one_row_of_each_component(spark):
    rng = random.Random(9)
    t, u, v, w = (words(rng, 80) for _ in range(4))
    every = [(2, t), (5, u), (5, t), (5, u), (7, v), (None, v), (None, w), (None, w), (9, None), (8, ""), (11, " ")]
    kept = simhash.one_of_each(spark.createDataFrame(rows(every), SCHEMA).repartition(4))
    got = Counter(tuple(r[1:3]) for r in kept.toDF(*(f"c{i}" for i in range(7))).collect())
    assert got == Counter([(2, t), (5, u), (7, v), (None, w), (8, "")])


# ---- 6 ----
def plain_lm(every, p):
    """Scores from plain counters, and weights by EM over single held-out tokens."""
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [0] for _, t in every]
    of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    folds = [{0: lm_scoring.HELD, 1: lm_scoring.DEV}.get(of(i), lm_scoring.MAIN) for i, _ in every]

    def counted(which):
        grams = Counter()
        for f, ts in zip(folds, tokens, strict=True):
            if f in which:
                line = [1, 1, *ts]
                for i in range(2, len(line)):
                    grams.update((tuple(line[i - k : i + 1]) for k in range(3)))
                grams[1,] += 1
                grams[1, 1] += 1
        return grams

    def views(ts):
        line = [1, 1, *ts]
        return [[tuple(line[i - k : i + 1]) for k in range(3)] for i in range(2, len(line))]

    def estimates(grams, n, gram3):
        out = [(0, grams[gram3[0]] / n if n else 0.0)]
        for g in gram3[1:]:
            c = grams[g[:-1]]
            out.append((min(c.bit_length(), p.buckets - 1), grams[g] / c if c else 0.0))
        return out

    def size(grams):
        words = [(g, c) for g, c in grams.items() if len(g) == 1 and g != (1,)]
        return sum(c for _, c in words), len(words)

    def mixed(weights, p0, found):
        for w, (b, own) in zip(weights, found, strict=False):
            p0 = w[b] * own + (1 - w[b]) * p0
        return p0

    main = counted({lm_scoring.MAIN})
    n, v = size(main)
    held = [estimates(main, n, g) for f, ts in zip(folds, tokens, strict=True) if f == lm_scoring.DEV for g in views(ts)]
    weights = []
    for order in range(3):
        ratios = [(x[order][0], x[order][1] / mixed(weights, 1 / (v + 1), x)) for x in held]

        def fit(rs, prior, strength):
            w = 0.5
            for _ in range(p.rounds):
                w = (sum(w * r / (w * r + 1 - w) for r in rs) + strength * prior) / (len(rs) + strength)
            return w

        pooled = fit([r for _, r in ratios], 0.5, 1)
        weights.append([fit([r for b, r in ratios if b == i], pooled, 10) for i in range(p.buckets)])
        if order:
            weights[-1][0] = 0.0
    every_gram = counted({lm_scoring.MAIN, lm_scoring.DEV})
    n, v = size(every_gram)
    out = []
    for (i, _), f, ts in zip(every, folds, tokens, strict=True):
        own = Counter(g for gram3 in views(ts) for g in gram3) + Counter([(1,), (1, 1)]) if f != lm_scoring.HELD else Counter()
        others = {g: every_gram[g] - own[g] for gram3 in views(ts) for g in [*gram3, *(x[:-1] for x in gram3)]}
        deleted = sum(math.log10(mixed(weights, 1 / (v + 1), estimates(others, n - len(ts) * (f != lm_scoring.HELD), g))) for g in views(ts))
        model = sum(math.log10(mixed(weights, 1 / (v + 1), estimates(every_gram, n, g))) for g in views(ts))
        base = sum(math.log10((every_gram[t,] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        out.append((i, f == lm_scoring.HELD, len(ts), sum(every_gram[t,] > 0 for t in ts), n, base, model, deleted))
    return out


def test_lm_scores(spark, docs, none, texts):
    p = lm_scoring.Interpolation(chunk_bytes=2000, rounds=40, task_bytes=2000)  # many chunks and buckets
    rng = random.Random(2)
    more = [(1000 + i, words(rng, 40, 30)) for i in range(300)]
    every = texts + more
    got = lm_scoring.score(docs.union(spark.createDataFrame(rows(more), SCHEMA)), p).collect()
    order = lambda r: (str(r[0]), r[2], r[5])
    for r, (*exact, base, model, deleted) in zip(sorted(got, key=order), sorted(plain_lm(every, p), key=order), strict=True):
        assert list(r[:5]) == exact
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model, rel=1e-4)
        assert r.deleted_score == pytest.approx(deleted, rel=1e-4)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm_scoring.score(none, p).count() == 0
    lonely = spark.createDataFrame(rows([(0, "a b")]), SCHEMA)  # crc32("0") % 10 is not 0; no held-out fold
    assert lm_scoring.score(lonely, p).first().train_tokens == (3 if lm_scoring.fold_of(0, p) else 0)


def test_known_mixture_is_learned():
    rng = np.random.default_rng(0)
    own, below = (x / x.sum() for x in rng.random((2, 4000)) + 0.01)
    each = 1e6 * (0.7 * own + 0.3 * below)  # what such a mixture draws on average
    h = [(3, 1, k, k * math.log2(r)) for k, r in zip(each, own / below, strict=True)]
    w = lm_scoring.learn(h, 3, lm_scoring.Interpolation(rounds=500))
    assert w[3] == pytest.approx(0.7, abs=1e-3) and w[0] == 0


# ---- 7 ----
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=11), min_size=1, max_size=6), st.text("abcd", max_size=12))
def test_trie_automata(terms, word):
    near = [(d, t) for t in terms if (d := edits(t, word)) <= toxicity.edits_for(len(t))]
    assert toxicity.Trie(terms).search(word) == (min(near) if near else None)


def plain_score(lexicon, text, window):
    """The evidence of all hits, every word against every term."""

    def kind(word):
        exact = [(word in lexicon.words, "exact", word)] + [(word.startswith(s), "stem", f"{s}*") for s in lexicon.stems]
        clear = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.get(c, c) for c in word)
        near = [(d, t) for t in lexicon.words if (d := edits(t, word)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
        for _, name, term in (x for x in exact if x[0]):
            return name, term
        if clear != word and any(c.isalpha() for c in word):
            for term in [t for t in lexicon.words if t == clear] + [f"{s}*" for s in lexicon.stems if clear.startswith(s)]:
                return "obscured", term
        return (f"edit{min(near)[0]}", min(near)[1]) if near and len(word) > 3 else None

    low = text.lower()
    places = [m.span() for m in re.finditer(r"(?:[^\W_]|[@$])+", low)]
    direct = {}
    for i, (a, b) in enumerate(places):
        if kind(low[a:b]):
            first, last = max(0, i - window), min(len(places) - 1, i + window)
            marks = all(any(q in side for q in toxicity.QUOTES) for side in (low[places[first][0] : a], low[b : places[last][1]]))
            told = any(low[x:y] in toxicity.REPORTING for x, y in places[first:i])
            direct[low[a:b]] = direct.get(low[a:b], False) or not (marks or told)
    if not direct:
        return lexicon.floor
    parts = []
    for side in (True, False):
        nats = [lexicon.strength[kind(w)] for w, d in direct.items() if d == side] or [0]
        parts.append((max(nats), math.log(1 + sum(nats) - max(nats))))
    x = [parts[0][0], parts[1][0], parts[0][1], parts[1][1], math.log(len({low[a:b] for a, b in places}))]
    odds = lexicon.floor / (1 - lexicon.floor) * math.exp(sum(w * v for w, v in zip(lexicon.weight, x, strict=True)))
    return odds / (1 + odds)


def test_scores_against_every_word_and_term():
    rng = random.Random(3)
    terms, stems = ("vile", "wretch", "scoundrels", "nitwit", "oy", "x"), ("scum", "dolt")
    strength = {(k, t): rng.random() * 5 for k in toxicity.KINDS for t in (*terms, *(f"{s}*" for s in stems))}
    lexicon = toxicity.Lexicon(terms, stems, strength, (0.9, 0.3, 1.2, 0.5, -0.4), 0.03)
    some = ["oy", "0y", "x", "0", "vile", "vyle", "wretch", "wr3tch", "wretches", "wretched", "scoundrel", "skoundrells", "scumbag", "$cumm", "dolts", "nitw1t", "said", "wrote", '"', "»", "plain", "words", "go", "here", "a", "É", "42"]
    texts = ["", " ", "VILE", *(" ".join(rng.choices(some, k=rng.randint(1, 30))) for _ in range(300))]
    p = toxicity.Toxicity(window=4)
    assert toxicity._scores(lexicon, pa.array(texts), p, step=7) == pytest.approx([plain_score(lexicon, t, 4) for t in texts], rel=1e-9)
    many = [" ".join(f"scum{'abcdefgh'[i]}" for i in range(n)) + " z" * (9 - n) for n in range(1, 9)]
    scores = toxicity._scores(toxicity.Lexicon((), ("scum",), strength, (0.5, 0.3, 0.5, 0.5, 0.0), 0.03), pa.array(many), p)
    assert scores == sorted(scores) and len(set(scores)) == 8  # each further word of a kind counts


def test_logistic_weights():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(400), rng.exponential(1, (400, 3)), rng.normal(0, 1, 400)])
    y, n = (rng.random(400) < 1 / (1 + np.exp(2 - x @ [0, 1.5, 0.4, -0.8, -1]))).astype(float), rng.integers(1, 4, 400).astype(float)
    start = np.array([0, 1, 0.4, 1, 0])
    beta = toxicity.logistic(x, y, n, start, 4.0)

    def loss(b):
        z = x @ b
        return (n * (np.logaddexp(0, z) - y * z)).sum() + 2 * ((b - start)[[1, 2, 4]] ** 2).sum()

    assert beta[3] == 0 and beta[4] < 0 and min(beta[1:3]) > 0  # what would speak for a text is left out
    for k in (0, 1, 2, 4):
        for d in (-0.01, 0.01):
            assert loss(beta + d * np.eye(5)[k]) > loss(beta)


def test_copies_of_labelled_rows(spark):
    """Near copies count once; rows that share a line, or their least words in a row, all stay."""
    rng = random.Random(9)
    line = "0 0 0 this line of a common license is in every row "
    own = [line + words(rng, 150) for _ in range(200)]
    base = words(rng, 3000, 5000)
    near = [" ".join([*base.split(), f"more{i}"]) for i in range(60)]
    sample = spark.createDataFrame([(t, y) for t in [*own, *own[:20], *near, "", ""] for y in ((0, 1) if t == "" else (0,))], "text string, toxic int").repartition(5)
    got = Counter((r.text, r.toxic) for r in toxicity._distinct(sample).collect())
    assert max(got.values()) == 1 and {(t, 0) for t in own} <= set(got)
    assert sum(t in near for t, _ in got) == 1 and {("", 0), ("", 1)} <= set(got) and len(got) == 203


def test_short_and_misspelled_terms_are_learned(spark, none):
    """Terms of one or two letters are terms; a misspelling tells of its term unless such words turn out to be others."""
    rng = random.Random(8)
    every, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        text = words(rng, 30).split() + [["oy"], ["blockhead"], ["nitwits"]][i // 4 % 3] * toxic + ["nitwitz"] * (i % 4 == 1)
        every.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    lexicon = toxicity.fit(spark.createDataFrame(rows(every), SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {"oy", "blockhead", "nitwits"} <= set(lexicon.words)
    p = toxicity.Toxicity()
    oy, blockhaed, blockheads, nitwitz = toxicity._scores(lexicon, pa.array([f"w1a w2e {w} w3i" for w in ("oy", "blockhaed", "blockheads", "nitwitz")]), p)
    assert min(oy, blockheads) >= 0.5 > nitwitz and blockhaed > nitwitz


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=5, max_size=11), st.data())
def test_pattern_keeps_every_near_word(term, data):
    word = data.draw(st.text("abcd", min_size=4, max_size=13))
    if data.draw(st.booleans()):
        at = data.draw(st.integers(0, len(term) - 1))
        word = term[:at] + data.draw(st.sampled_from(["", "x", "x" + term[at]])) + term[at + 1 :]
    lexicon = toxicity.Lexicon((term,))
    if len(word) >= 4 and lexicon.kind(word):
        assert lexicon.rows_with_hits(pa.array([f"x {word} y"], pa.large_string()))[0].tolist() == [True]


def test_toxicity(spark, none):
    rng = random.Random(3)
    bad = ["vilewretch", "scumbag", "stupidoaf", "nastything"]
    every, labels = [], []
    for i in range(900):
        text, toxic = words(rng, 60).split(), rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(60), rng.choice(bad))
        every.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows(every), SCHEMA)
    found = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int"))
    assert set(bad) <= set(found.words)
    got = {r.doc_id: r for r in toxicity.score(docs, found).collect()}
    assert all(got[i].predicted == t for i, t in labels if got[i].held_out) and len(got) == 900
    odd = spark.createDataFrame(rows([(1, None), (2, ""), (None, "x"), (3, "you scumb4g and n4stything and vilewretch"), (4, 'he wrote "scumbag" once')]), SCHEMA)
    scores = {r.doc_id: r.score for r in toxicity.score(odd, found).collect()}
    assert scores[1] == scores[2] == found.floor and scores[3] >= 0.5 > scores[4]
    kept = toxicity.without_toxic(docs, found)
    assert set(ids_of(kept)) == {i for i, r in got.items() if not r.predicted} and kept.columns == docs.columns
    assert toxicity.score(none, found).count() == 0
    blank = toxicity.fit(none, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(odd, blank).filter("predicted = 1 or score is null").count() == 0


# ---- 8 ----
@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from([1, 7, 4096]))
def test_png_round_trip(raw, band):
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert media.read_png(media.write_png(payload, band=band)).tobytes() == payload


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    smooth = np.cumsum(np.cumsum(rng.integers(-1, 2, (300, 64)), 0), 1).astype(np.uint8)
    raw = media.write_png(smooth.tobytes())
    assert media.read_png(raw).tobytes() == smooth.tobytes() and len(raw) < smooth.size * 0.9
    for kind in range(5):  # each filter alone, by its definition
        out = np.empty((300, 65), np.uint8)
        for y in range(300):
            for x in range(64):
                a, b, c = (int(smooth[y - j, x - i]) if x >= i and y >= j else 0 for i, j in ((1, 0), (0, 1), (1, 1)))
                best = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                out[y, 0], out[y, x + 1] = kind, (int(smooth[y, x]) - [0, a, b, (a + b) // 2, best][kind]) % 256
        assert (media.unfiltered([out])[0] == smooth).all()
    for at in (0, 20, 45, len(raw) - 1):
        with pytest.raises(ValueError):
            media.read_png(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    with pytest.raises(ValueError):
        media.read_png(raw[:-12])
    flat = media.write_png(bytes(64))
    at, end = flat.index(b"IDAT") - 4, flat.index(b"IEND") - 4
    data = zlib.compress(bytes(65))
    right = b"".join((flat[:at], media._chunk(b"IDAT", data), flat[end:]))
    assert media.read_png(right).tobytes() == bytes(64)
    for wrong in (data + b"more", data[:-1], data[:-4] + b"fail", b"no deflate stream", zlib.compress(bytes(66)), zlib.compress(bytes([5]) + bytes(64))):
        with pytest.raises(ValueError):
            media.read_png(b"".join((flat[:at], media._chunk(b"IDAT", wrong), flat[end:])))
    with pytest.raises(ValueError):
        media.read_png(flat[:8] + media._chunk(b"IHDR", bytes(5)) + flat[end:])


def test_filters_are_chosen_by_row_and_undone_together():
    rng = np.random.default_rng(7)
    text = np.frombuffer(("some words of plain prose, as they come. " * 200).encode()[: 64 * 100], np.uint8).reshape(100, 64)
    ramp = (np.arange(64)[None, :] * 3 + rng.integers(0, 2, (100, 1)) + np.arange(100)[:, None] * 7).astype(np.uint8)
    plane = (np.add.outer(np.arange(100) ** 2 // 9, np.arange(64) ** 2 // 7) & 255).astype(np.uint8)
    mixed = np.vstack([text[:80], ramp, text[:5], plane, rng.integers(0, 256, (40, 64)).astype(np.uint8)])
    images = [mixed, text, ramp, plane, mixed[::-1].copy(), text[:1], ramp[:1]]
    stored = [media.filtered_rows(media.write_png(x.tobytes(), band=64)) for x in images]
    kinds = stored[0][:, 0]
    assert (kinds[2:80] == 0).mean() > 0.9 and (kinds[82:180] != 0).all() and len(set(kinds.tolist())) >= 3  # a row at a time
    for together in (1, 20_000, 1 << 20):
        assert all((a == b).all() for a, b in zip(media.unfiltered(stored, together), images, strict=True))
    for _ in range(30):  # any filters at all, of images of several heights
        wild = [np.hstack([rng.integers(0, 5, (h, 1)), rng.integers(0, 256, (h, 64))]).astype(np.uint8) for h in rng.integers(1, 9, 6)]
        for rows_, got in zip(wild, media.unfiltered(wild), strict=True):
            above = [0] * 64
            for row, out in zip(rows_.tolist(), got.tolist(), strict=True):
                want = []
                for x, v in enumerate(row[1:]):
                    a, b, c = want[x - 1] if x else 0, above[x], above[x - 1] if x else 0
                    best = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                    want.append((v + [0, a, b, (a + b) // 2, best][row[0]]) % 256)
                assert out == want
                above = want


def test_cosine_hash():
    rng = np.random.default_rng(2)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    near = np.clip(image.astype(int) + rng.integers(-2, 3, image.shape), 0, 255).astype(np.uint8)
    bits = lambda i: int(media.cosine_hash(i), 16)
    assert (bits(image) ^ bits(near)).bit_count() <= 12 < (bits(image) ^ bits(rng.integers(0, 256, image.shape).astype(np.uint8))).bit_count()


def plain_png(raw):
    """Samples of a grey PNG, by the format's description alone."""
    assert raw[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, found = 8, {}
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4]), raw[at + 4 : at + 8]
        assert zlib.crc32(raw[at + 4 : at + 8 + n]) == int.from_bytes(raw[at + 8 + n : at + 12 + n])
        found[kind] = found.get(kind, b"") + raw[at + 8 : at + 8 + n]
        at += 12 + n
    width, height = (int.from_bytes(found[b"IHDR"][i : i + 4]) for i in (0, 4))
    data = zlib.decompress(found[b"IDAT"])
    lines = [data[i : i + width + 1] for i in range(0, len(data), width + 1)]
    assert len(lines) == height and found[b"IHDR"][8:] == bytes([8, 0, 0, 0, 0]) and all(x[0] < 5 for x in lines)
    out, above = [], bytes(width)
    for kind, *line in lines:
        row: list[int] = []
        for x, v in enumerate(line):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            best = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row.append((v + [0, a, b, (a + b) // 2, best][kind]) % 256)
        out.append(above := bytes(row))
    return b"".join(out)


def plain_feature(samples):
    """Bits of the lowest 8 x 8 coefficients of the cosine transform of 32 x 32 means, sample by sample."""
    h = len(samples) // 64
    grid = []
    for y in range(32):
        a = y * h // 32
        lines = range(a, max(a + 1, (y + 1) * h // 32))
        grid.append([sum(samples[64 * r + 2 * x] + samples[64 * r + 2 * x + 1] for r in lines) / (2 * len(lines)) for x in range(32)])
    wave = [[math.cos(math.pi / 32 * k * (n + 0.5)) for n in range(32)] for k in range(8)]
    low = [round(1024 * sum(wave[u][y] * wave[v][x] * grid[y][x] for y in range(32) for x in range(32))) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = [low[0] > 0, *(c > middle for c in low[1:])]
    return f"{int(''.join('01'[b] for b in bits), 2):016x}"


def test_media_columns(spark, docs, none, texts):
    wanted = Counter()
    stored = {(r.doc_id, r.n_bytes): bytes(r.media) for r in media.to_media(docs).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        png = stored[i, len(raw)]
        assert plain_png(png) == payload
        wanted[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), plain_feature(payload)] += 1
    assert Counter(map(tuple, media.features(media.to_media(docs)).collect())) == wanted


def test_equal_texts_have_equal_media(spark, docs, none, texts):
    got = media.features(media.to_media(docs)).collect()
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(v) == 1 for v in by_text.values())
    wanted = Counter()
    for i, t in texts:
        payload, n = media.payload_of(t)
        assert len(payload) % 64 == 0 and payload[:n] == (t or "").encode() and not any(payload[n:])
        wanted[i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == wanted
    assert media.features(media.to_media(none)).count() == 0


# ---- 10 ----
def plain_shard(key, tree):
    path, out = "", []
    for _ in range(3):
        draws = [(-math.log((int(hashlib.md5(f"{key}|{path}/{c}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w, c) for c, w in tree.children()[path].items()]
        out.append(min(draws)[1])
        path = "/".join(map(str, out))
    return out[2]


def test_sharding(spark, docs, none, texts):
    tree = sharding.Tree.even(2, 3, 4)
    got = sharding.place(docs, tree, tree.grown()).collect()
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.shard == plain_shard(key, tree) and r.grown_shard == plain_shard(key, tree.grown()) and r.grown_shard in (r.shard, 24)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.place(none, tree, tree.grown()).count() == 0


def test_weights_move_rows_only_across_their_subtree():
    tree = sharding.Tree.even(2, 2, 2)
    heavier = sharding.Tree(tuple((r, k, s, 3.0 if s == 0 else w) for r, k, s, w in tree.shards))
    for i in range(2000):
        a, b = plain_shard(i, tree), plain_shard(i, heavier)
        assert a == b or b // 4 == 0  # only into the region whose weight rose
    share = Counter(plain_shard(i, heavier) for i in range(4000))
    assert 0.25 < share[0] / 4000 < 0.35


# ---- 2 ----
def plain_best(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row), row.index(min(row))


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abcd", max_size=90))
def test_myers(item, text):
    got, plain = decontamination.Myers(item).best(text), plain_best(item, text)
    assert got == plain or plain[0] == len(item) == got[0]


def test_decontamination(spark, none):
    rng = random.Random(4)
    p = decontamination.Decontamination()
    items = [(i, words(rng, 30)) for i in range(6)] + [(6, None), (7, ""), (8, "too short"), (9, "x"), (10, "İstanbul"), (11, "?!"), (12, "Istanbul Straße, 中文")]
    every = [(i, words(rng, 200)) for i in range(30)]
    for i in range(24):
        text = list(items[i % 6][1])
        for _ in range(i):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["Q"], [text[at], "q"]])
        every.append((100 + i, f"{words(rng, 50)}\n{''.join(text).upper()}. {words(rng, 50)}"))
    every += [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1]), (202, items[1][1]), (203, items[0][1][:40]),
              (204, "it is TOO-short"), (205, "not too shortened"), (206, "x"), (207, "in İSTANBUL."), (208, "中文 İstanbul"), (209, "istanbul strasse"), (210, "at istanbul straße 中文")]
    docs, bench = spark.createDataFrame(rows(every), SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id, r.edits) for r in decontamination.leaks(docs, bench, p).collect())
    wanted = Counter()
    for i, t in every:
        for item_id, item in items:
            n = decontamination.normal(item)
            text = decontamination.normal(t)
            if n and text and (d := plain_best(f" {n} ", f" {text} ")[0]) <= p.budget(len(n)):
                wanted[i, item_id, d] += 1
    wanted = +wanted
    assert {(204, 8, 0), (206, 9, 0), (207, 10, 0), (208, 10, 0), (210, 12, 0)} <= set(wanted)
    assert got == wanted and {d for *_, d in wanted} > {0, 5}
    kept = decontamination.clean(docs, bench, p)
    leaky = {i for i, *_ in wanted}
    assert sorted(i for i in ids_of(kept) if i is not None) == sorted(i for i, _ in every if i is not None and i not in leaky)
    small = decontamination.Decontamination(block_chars=100)  # several blocks of items
    assert Counter((r.doc_id, r.item_id, r.edits) for r in decontamination.leaks(docs, bench, small).collect()) == wanted
    assert sorted(map(str, ids_of(decontamination.clean(docs, bench, small)))) == sorted(map(str, ids_of(kept)))
    assert decontamination.leaks(none, bench, p).count() == 0 and decontamination.leaks(docs, bench.limit(0), p).count() == 0
    assert len(ids_of(decontamination.clean(docs, bench.limit(0), p))) == len(every)


def test_one_normal_form():
    every = [f"a{chr(i)}b {chr(i)} {chr(i) * 2}X" for i in range(0x260)] + ["İ x", "x İ 中"]
    assert decontamination._texts(pa.array(every)) == [decontamination.normal(t) for t in every]


@pytest.mark.parametrize("length", [24, 100, 233, 394])
def test_edits_up_to_the_rate(length):
    """Edits as far apart as can be leave the shortest pieces unchanged."""
    rng = random.Random(length)
    item = "".join(rng.choices("abcdefghij", k=length))
    most = length // 10
    at = [length * i // (most + 1) for i in range(1, most + 2)]
    matcher = decontamination.Matcher([(1, item)], decontamination.Decontamination())
    changed = lambda places: "".join("z" if i in places else c for i, c in enumerate(item))
    assert [m[:2] for m in matcher.matches(f"before {changed(at[:most])} after")] == [(1, most)]
    assert matcher.matches(f"before {changed([p - 1 for p in at])} after") == []


# ---- 1 ----
def test_license_scan(spark, none, texts):
    mit = license_scan.TEMPLATES["MIT"]
    every = [
        (1, "Some prose.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 3.0.\nprose follows"), (3, "a license to kill is no notice"), (4, None), (5, ""),
        (6, f"Text.\n{mit.replace('obtaining a copy', 'getting copies')}\nMore text here"), (None, "This work is licensed under the GNU General Public License, version 2."), (7, "x Licensed under the Apache License, Version 2.0. y"),
        (8, "Released under the MIT License. Licensed under CC BY 4.0."), (8, "Released under the MIT License. Licensed under CC BY 4.0."),
    ]
    docs = spark.createDataFrame(rows([*every, *((i, t) for i, t in texts if i is not None)]), SCHEMA)
    got = Counter((r.doc_id, r.license, r.missing, r.added, r.version) for r in license_scan.scan(docs).collect())
    assert got == Counter(
        [
            (1, "MIT-notice", "", "", ""), (2, "CC-BY-NC-notice", "4.0", "3.0", "3.0"), (6, "MIT", "obtaining a copy", "getting copies", ""), (None, "GPL-2.0-notice", "", "", "2"),
            (7, "Apache-2.0-notice", "", "", "2.0"), *[(8, "MIT-notice", "", "", ""), (8, "CC-BY-notice", "", "", "4.0")] * 2,
        ]
    )
    assert all(0 < r.reduction < 1 and r.conditional_bytes < r.plain_bytes for r in license_scan.scan(docs).collect())
    assert license_scan.scan(none).count() == 0


def test_notice_beside_reworded_licenses():
    """A block's compressed size may favour other templates than that of the notice it holds."""
    isc = "Permission to use, copy, modify and distribute this software for any purpose is granted without fee provided that the copyright notice appear in all copies, subject to the following conditions."
    gpl = "You can redistribute this program and modify it under the terms of the license that the Free Software Foundation published, in version 2 or any later version of the License."
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.LicenseScan())
    for name in ("MIT-notice", "CC-BY-notice", "CC-BY-NC-ND-notice", "CC0-notice", "LGPL-notice", "MPL-notice"):
        for block in (f"{isc} {license_scan.TEMPLATES[name]}", f"{license_scan.TEMPLATES[name]} {gpl} {isc}"):
            found = scanner.notices(license_scan.words_of(block))
            assert (name, "", "") in [(n.license, n.missing, n.added) for n in found]
            assert all(n.conditional < n.plain for n in found)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_repeated_and_mixed_notices():
    scanner, of = license_scan.Scanner(license_scan.TEMPLATES, license_scan.LicenseScan()), license_texts.NOTICES | license_texts.TEXTS
    found = lambda text: [(n.license, n.missing, n.added) for n in scanner.notices(license_scan.words_of(text))]
    for a in of:
        for b in of:
            assert found(f"Prose. {of[a]} {of[b].upper()}\n{of[a]}") == [(n, "", "") for n in (a, b, a)]
    assert found(f"{of['CC-BY-notice']} " * 2000) == [("CC-BY-notice", "", "")] * 2000
    assert found(f"{of['MIT-notice']} under {of['CC-BY-notice'][15:]} {of['MIT-notice']}") == [("MIT-notice", "", ""), ("CC-BY-notice", "licensed", ""), ("MIT-notice", "", "")]


def test_notices_against_all_stretches():
    """Every stretch within a template's budget is a notice or overlaps one; notices are apart and within theirs."""
    rng, p = random.Random(8), license_scan.LicenseScan()
    of = {n: t for n, t in (license_texts.NOTICES | dict(list(license_texts.SHORT.items())[::7])).items() if len(license_scan.words_of(t)) <= 14}
    scanner = license_scan.Scanner(of, p)
    for _ in range(40):
        text: list[str] = []
        for _ in range(rng.randint(1, 4)):
            part = license_scan.words_of(rng.choice(list(of.values())))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["other"], [part[at], "more"]])
            text += part + rng.choices(["plain", "the", "license", "by"], k=rng.randint(0, 3))
        notices = scanner.notices(text)
        covered = [0] * len(text)
        for n in notices:
            wording = license_scan.words_of(of[n.license])
            assert plain_distance(wording, text[n.begin : n.end]) <= p.budget(len(wording))
            for i in range(n.begin, n.end):
                covered[i] += 1
        assert max(covered, default=0) <= 1
        for name, template in of.items():
            wording = license_scan.words_of(template)
            k = p.budget(len(wording))
            for a in range(len(text)):
                for b in range(a + max(1, len(wording) - k), min(len(text), a + len(wording) + k) + 1):
                    assert any(covered[a:b]) or not named_alike(name, wording, text[a:b]) or plain_distance(wording, text[a:b]) > k, (name, text[a:b])


def named_alike(name, wording, part):
    names = license_texts.NAMING | (license_texts.CC_PARTS if "cc" in wording else frozenset())
    need, have = names & set(wording), names & set(part)
    return need <= have <= need | names & set(license_scan.words_of(name))


def test_wrong_names_are_rejected():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.LicenseScan())
    found = lambda text: [(n.license, n.missing, n.added) for n in scanner.notices(license_scan.words_of(text))]
    assert all(found(f"Prose. {t} More.") == [(n, "", "")] for n, t in license_scan.TEMPLATES.items())
    assert found("Released under the Labour License. Licensed under a by 4.0, Distributed under the Eclipse Software License, Version 1.0.") == []
    for text, name in {
        "Released under the Apache License.": "Apache-released", "Released under the BSD License.": "BSD-released", "This software is released under the ISC license.": "ISC-software", "GPL, version 2 or later": "GPL-2-or-later-short",
        "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0-spdx", "License: MIT": "MIT-field", f"{license_scan.TEMPLATES['GPL'].replace('version 3', 'version 2')}": "GPL-2.0",
    }.items():
        assert found(text) == [(name, "", "")]


def test_ranking_by_every_template():
    import zstandard as z

    rng, of = random.Random(12), license_scan.TEMPLATES
    p = license_scan.LicenseScan()
    scanner, wording = license_scan.Scanner(of, p), {n: license_scan.words_of(t) for n, t in of.items()}
    size = lambda text, known=None: len(z.ZstdCompressor(level=p.level, write_content_size=False, write_checksum=False, write_dict_id=False, **({"dict_data": known} if known else {})).compress(text.encode()))
    given = {n: z.ZstdCompressionDict(" ".join(ws).encode(), dict_type=z.DICT_TYPE_RAWCONTENT) for n, ws in wording.items()}
    seen = 0
    for name in rng.sample(list(of), 60):
        part = list(wording[name])
        for _ in range(rng.choice([0, 1, 2])):
            part[rng.randrange(len(part))] = "other"
        for n in scanner.notices(["some", "prose", *part, "and", "more"]):
            words_ = ["some", "prose", *part, "and", "more"][n.begin : n.end]
            block = " ".join(words_)
            fits = {m: size(block, given[m]) for m, ws in wording.items() if named_alike(m, ws, words_) and plain_distance(ws, words_) <= p.budget(len(ws))}
            assert n.plain == size(block) and n.conditional == fits[n.license] < n.plain
            same = [m for m, s in fits.items() if s < fits[n.license]]  # only another version may be shorter
            letters = lambda ws: [w for w in ws if not w[0].isdigit()]
            assert all(letters(wording[m]) == letters(wording[n.license]) for m in same)
            seen += 1
    assert seen >= 30


# ---- 3 ----
def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes <|im_end|>"), (0, 2, "user", "why"), (0, 3, "assistant", "so"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 1, "assistant", "no"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"), (4, None, None, None), (7, 5, "user", "alone"), (None, 0, "user", "x"),
        *((8, n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(200)), *((9, n, "user" if n % 2 == 0 else "assistant", f"t{n}" if n < 150 else "other") for n in range(170)),
    ]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, TEXT string").repartition(3)
    got = preferences.format_pairs(preferences.buddies(df))
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", table)
    names = got.columns
    wanted = con.sql(preferences.OP3_SQL).select(", ".join(names)).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(wanted)
    whole = {r.pair_id: r for r in preferences.assemble(got).collect()}
    r = whole[0]
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert [r.chosen[a:b] for a, b in r.chosen_mask] == ["yes \\<|im_end|><|im_end|>\n", "so<|im_end|>\n"] and [r.rejected[a:b] for a, b in r.rejected_mask] == ["no<|im_end|>\n"] * 2
    assert whole[1].chosen == whole[1].rejected == "" and whole[1].prompt and whole[3].prompt == "" and whole[4].prompt.count("im_start") == 150
    assert preferences.format_pairs(preferences.buddies(df.limit(0))).count() == 0


# ---- pipeline ----
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    every = [(i, words(rng, rng.randrange(30, 200), 5000)) for i in range(300)]
    labels = [(i, 0) for i in range(300)]
    for i in range(300, 380):
        text = words(rng, 60, 5000).split()
        for _ in range(3):
            text.insert(rng.randrange(60), rng.choice(["vilewretch", "scumbag"]))
        every.append((i, " ".join(text)))
        labels.append((i, 1))
    items = [(i, words(rng, 30, 5000)) for i in range(5)]
    every += [(400 + i, f"{words(rng, 40, 5000)} {items[i][1]} {words(rng, 40, 5000)}") for i in range(5)]
    every += [(500 + i, every[i][1]) for i in range(20)] + [(600, words(rng, 3000, 5000)), (601, ""), (602, None)]
    data = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in every], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{data}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{data}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{data}/benchmark.parquet")
    left = [(i, t) for i, t in every if not 300 <= i < 380]
    pairs = [(i, plain_fingerprint(t)) for i, t in left]
    left = [x for x, c in zip(left, plain_components(pairs), strict=True) if x[0] == c]
    left = [(i, t) for i, t in left if not any(plain_best(item, t)[0] <= 15 for _, item in items if t and i >= 400 and i < 600)]
    got = corpus_pipeline.run(spark, str(data)).toPandas()
    sizes = dict(zip((i for i, _ in left), map(len, plain_ids("byte_bpe_50k.json", left, 0)), strict=True))
    assert got.groupby("doc_id")["length"].sum().to_dict() == sizes
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert {i for i in sizes if 300 <= i < 500} == set() and 601 in sizes and 602 not in sizes


def test_pipeline_without_rows(spark, tmp_path):
    import corpus_pipeline

    data = tmp_path / "none"
    for name, schema in (("documents", SCHEMA.replace("Doc_Id string, ", "").replace(", TEXT string", "")), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{data}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(data)).count() == 0


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    data = tmp_path / "few"
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{data}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark passage of this test")], "item_id bigint, text string").write.parquet(f"{data}/benchmark.parquet")
    docs = spark.createDataFrame(rows([(1, "a text of some words"), (2, "a text of some words"), (3, "here is some benchmark passage of this test"), (None, None)]), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(data))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(map(str, ids_of(docs))) == ["1", "None"]
    assert set(corpus_pipeline.STAGES[3][1](spark, docs, str(data)).toPandas()["length"]) == {1, 6}


def test_entry_has_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and datetime.date
