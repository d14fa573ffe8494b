"""Chats, URLs, neighbours, components, the pipeline, and the queries against SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm.chat import conversation_events, format_chats, op4_chat, read_turns
from sedimenta.llm.components import components
from sedimenta.llm.neighbours import search, unit
from sedimenta.llm.quality import LEAST, SHARE
from sedimenta.llm.queries import ORACLE_SQL, QUERIES
from sedimenta.llm import urls
from sedimenta.llm.urls import bloom_filter, canonical, filter_urls, host_of, path_of

from ..oracle import compare
from .cases import SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"
EVENTS = "conv long, seq long, kind string, msg long, role string, text string, pieces string"


def chats(spark, rows):
    out = format_chats(spark.createDataFrame([(*r, "clash") for r in rows], EVENTS))
    return {r["conv"]: r for r in out.withColumn("read", read_turns(F.col("formatted"))).collect()}


def test_fold_of_events(spark):
    log = [
        (1, 1, "start", 0, "user", "hel"), (1, 2, "delta", 0, None, "lo"), (1, 3, "start", 1, "assistant", None), (1, 4, "delta", 1, None, "bad"),
        (1, 5, "start", 2, "user", "and then?"), (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, None, "go"), (1, 8, "delta", 1, None, "od"),
        (1, 9, "start", 3, "user", "fine"), (1, 10, "edit", 3, None, "thanks"), (1, 11, "delta", 3, None, "!"),
        (2, 1, "message", 1, "assistant", "<b>\\l</turn>\n"), (2, 0, "message", 0, None, None), (None, 1, "message", 0, "user", "no id"), (2, 2, "message", 2, "a>b", "x"), (2, 2, "message", 2, "a>b", "x"),
    ]
    random.Random(1).shuffle(log)
    out = chats(spark, log)
    said = lambda c: [(t["role"], t["text"]) for t in out[c]["read"]]
    assert said(1) == [("user", "hello"), ("assistant", "good"), ("user", "thanks!")]
    assert said(2) == [("", ""), ("assistant", "<b>\\l</turn>\n"), ("a>b", "x"), ("a>b", "x")]
    assert said(None) == [("user", "no id")]
    for r in out.values():
        runs, at, learned = r["mask_runs"], 0, []
        for i, n in enumerate(runs):
            if i % 2:
                learned.append(r["formatted"][at : at + n])
            at += n
        assert at == len(r["formatted"]) and "".join(learned) == "".join(p["piece"] for p in r["pieces"] if p["loss"])
    assert chats(spark, []) == {}


def test_a_regeneration_undoes_whole_messages_too(spark):
    log = [(1, 1, "message", 0, "user", "ask"), (1, 2, "start", 1, "assistant", "bad"), (1, 3, "message", 2, "user", "later"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "good"), (1, 6, "message", 3, "user", "thanks"), (1, 7, "message", 1, "user", "beside"), (1, None, "message", 4, "user", "when?")]
    assert [t["text"] for t in chats(spark, log)[1]["read"]] == ["ask", "good", "beside", "thanks"]


def test_conversations_become_logs_of_all_kinds(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"text {i} \U0001F600 é" if i != 4 else None) for i in range(9)] + [(2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, None, "user", "x"), (None, 1, None, "y")]
    events = conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r[0]: r[1] for r in events.groupBy("kind").count().collect()}
    assert set(kinds) == {"start", "delta", "edit", "regenerate"} and kinds["start"] == len(rows)
    out = {r["conv"]: r["read"] for r in format_chats(events).withColumn("read", read_turns(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]] == [(r[2], r[3] or "") for r in rows[:9]]
    assert [t["text"] for t in out[2]] == ["x", "a", "a", "b"] and [tuple(t) for t in out[None]] == [("", "y")]


def test_unknown_kind_fails(spark):
    with pytest.raises(Exception, match="unknown event kind"):
        chats(spark, [(1, 1, "vanish", 0, "user", "x")])


def test_chat_query(spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    t = "\\### Assistant: </turn> ok"
    by[-7] = [(0, "user", t), (1, "assistant", t)]
    out = op4_chat(spark, SF).collect()
    assert len(out) == len(by)
    for r in out:
        turns = sorted(by[r["conv_id"]])
        learned = "".join(x for _, role, x in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


URLS = [None, "", "no scheme", "HTTP://Example.COM/en/1?x#y", "https://a.example.com/en/7/8", "http://b.net/de/", "http://example.net/de/8", "ftp://x.org/es/", "http://xorg/es/", "http://www.spam.io/a/?b=2&a=1&utm_source=q", "http://spam.io/a?a=1&b=2", "http://spam.io/a", "http://m.spam.io/a.html#t", "://", "http://É.com/en/ü"]
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@pytest.mark.parametrize("most", [None, 0])
def test_urls(spark, monkeypatch, most):
    """With a small list, and as if filter and hits were too large for a broadcast."""
    if most is not None:
        monkeypatch.setattr(urls, "MOST_BLOCKS", most)
        monkeypatch.setattr(urls, "MOST_LISTED", most)
    pages = spark.createDataFrame([(i, u, *["clash"] * 7) for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string, block string, word0 string, __block string, __own string, __hit string, name string")
    listed = spark.createDataFrame([("http://spam.io/a/",), ("http://spam.io/a?b=2&a=1",), (None,), ("http://spam.io/a",)], "url string")
    rows = {r["page_id"]: r for r in filter_urls(pages, listed, RULES).collect()}
    assert len(rows) == 2 * len(URLS) and all(r[c] == "clash" for r in rows.values() for c in ("block", "word0", "__block", "__own", "__hit", "name"))
    got = [(rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) for i in range(len(URLS))]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/1", "com/en/", "block"), ("a.example.com", "/en/7/8", "example.com/en/7", "allow"),
        ("b.net", "/de/", "net/de/", "block"), ("example.net", "/de/8", "example.net/de/8", "block"), ("x.org", "/es/", "org/es/", "block"), ("xorg", "/es/", None, "allow"),
        ("www.spam.io", "/a/", None, "block"), ("spam.io", "/a", None, "block"), ("spam.io", "/a", None, "block"), ("m.spam.io", "/a.html", None, "block"), ("", "", None, "allow"), ("É.com", "/en/ü", "com/en/", "block"),
    ]
    assert filter_urls(pages.limit(0), listed, RULES).count() == 0
    assert filter_urls(pages, listed.limit(0), []).filter("verdict = 'block'").count() == 0
    with pytest.raises(ValueError):
        filter_urls(pages, listed, RULES * 300)


def test_the_query_goes_by_the_rules_of_its_contract(spark, tmp_path):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    at = ["http://a.com/en/1", "http://example.com/en/7", "http://b.example.net/de/9", "http://example.net/de/8", "http://x.org/es/"]
    spark.createDataFrame(list(enumerate(at)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["rule"]: r["verdict"] for r in urls.op7_urls(spark, str(tmp_path)).collect()} == want


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("host/"), "id").alias("url"))
    words, blocks = bloom_filter(urls)
    assert blocks == 1024 and words.count() <= blocks
    from sedimenta.llm.urls import bits

    probe = spark.range(40_000).select("id", F.concat(F.lit("host/"), "id").alias("url")).withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks))).withColumn("k", F.xxhash64("url", F.lit(1)))
    hit = F.expr("true")
    for i, b in enumerate(bits(F.col("k"))):
        hit = hit & (F.col(f"word{i}").bitwiseAND(b) != 0)
    row = probe.join(words, "block").filter(hit).agg(F.count_if(F.expr("id < 20000")), F.count_if(F.expr("id >= 20000"))).first()
    assert row[0] == 20_000 and row[1] < 1000


def test_canonical(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select(canonical(F.col("u")), host_of(F.col("u")), path_of(F.col("u"))).collect()
    assert df[0][0] is None and df[9][0] == df[10][0] == "spam.io/a?a=1&b=2" and df[12][0] == "spam.io/a"


def nearest(rows, k, asked):
    out = {}
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    x = unit(np.array([v for _, v in ok], np.float32))
    ids = np.array([i for i, _ in ok])
    for n, (i, _) in enumerate(ok):
        if asked(i):
            s = (x * x[n]).sum(1)
            near = np.flatnonzero(ids != i)
            out[i] = [(int(ids[j]), float(s[j])) for j in near[np.lexsort((ids[near], -s[near]))][:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(9)] + [(400, None), (450, [0.0] * 8), (451, [float("nan")] * 8), (452, [1.0] * 7 + [None]), (453, [1.0] * 9), (None, [1.0] * 8), (454, [float("inf")] + [0.0] * 7), (455, [])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, part string")
    want = nearest(rows, 5, lambda i: i % 50 == 0)
    got = defaultdict(list)
    for r in search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q], strict=True))
    few = search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert search(df.limit(0), F.lit(True)).count() == 0 and search(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall(spark, monkeypatch, clusters):
    """Vectors with and without structure, a third of them one vector; parts and blocks are split."""
    from sedimenta.llm import neighbours

    monkeypatch.setattr(neighbours, "PART", 700)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8_000, 32)).astype(np.float32)
    if clusters:
        x = rng.normal(size=(clusters, 32)).astype(np.float32)[rng.integers(0, clusters, 8_000)] + 0.3 * x
    x[rng.random(8_000) < 1 / 3] = x[1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in search(df, F.col("vec_id") % 200 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u, hits = unit(x), 0
    for q in range(0, 8_000, 200):
        s = (u * u[q]).sum(1)
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
        assert all(abs(score - s[i]) < 1e-12 for i, score in got[q])
        if s[best[0]] > 1 - 1e-9:  # copies: those with the smallest ids, in their order
            assert [i for i, _ in got[q]] == best.tolist()
    assert hits >= 0.9 * 5 * 40


def test_coarse_codes_hide_no_neighbour(spark):
    """Few words describe these vectors badly, so that the first to be scored are seldom the nearest."""
    rng = np.random.default_rng(8)
    x = (2 + rng.normal(size=(5_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in search(df, F.col("vec_id") % 100 == 0, rerank=16, books=2, words=16).collect():
        got[r["query_id"]].add(r["vec_id"])
    u = unit(x)
    hits = 0
    for q in range(0, 5_000, 100):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.97 * 5 * 50


def test_packed_keys():
    from sedimenta.llm.common import packed, unpacked

    rng = np.random.default_rng(4)
    for n, most in ((1, 2**64), (2, 2**64), (1000, 2**64), (1000, 2000), (3, 4)):
        keys = np.unique(rng.integers(0, most - 1, n, np.uint64, endpoint=True))
        assert (unpacked(packed(keys)) == keys).all()
    assert len(unpacked(b"")) == 0
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert (unpacked(packed(ends)) == ends).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    from tokenizers import Tokenizer

    from . import test_documents as by_hand

    line = "accept 12 cookies and read our terms before you go on to the next of our many pages please"
    rows = [r for r in documents() if r[0] is not None] + [(3000 + i, f"{prose(4000 + i, 8 + i % 30)}\n{line}", "en", "shop", 0) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialised(stage(spark, docs, str(tmp_path)))
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    verdicts = by_hand.judged(rows, LEAST, SHARE)
    assert Counter(seen["quality"]) == Counter(r for r, (_, _, kept) in zip(rows, verdicts, strict=True) if kept)
    assert sum(gone > 0 and not kept for _, gone, kept in verdicts) > 5

    plain = lambda r: (*r[:2], *r[3:])
    assert not Counter(map(plain, seen["language"])) - Counter(map(plain, seen["quality"])) and {r[2] for r in seen["language"]} <= {"en", "de"}
    assert len(seen["language"]) > 0.8 * len(seen["quality"])

    _, roots = by_hand.classes(seen["language"])
    least = {}
    for r, root in zip(seen["language"], roots, strict=True):
        least[root] = min(least.get(root, r[0]), r[0])
    assert sorted(r[0] for r in seen["near_duplicates"]) == sorted(least.values())
    assert not Counter(seen["near_duplicates"]) - Counter(seen["language"])

    words = [by_hand.WORD.findall(r[1]) for r in seen["near_duplicates"]]
    windows = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = {}
    for r, w in zip(seen["near_duplicates"], words, strict=True):
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[r[0]] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
    assert {r[0]: r[1] for r in seen["substrings"]} == want and any(a[1] != b[1] for a, b in zip(sorted(seen["substrings"]), sorted(seen["near_duplicates"]), strict=True))
    assert all(r[4] == len(r[1]) for r in seen["substrings"])

    tokenizer = Tokenizer.from_file(by_hand.BPE)
    pieces = Counter()
    for r in seen["substrings"]:
        ids = np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for i, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096].tobytes()
            pieces[r[0], i, a, len(part) // 4, zlib.crc32(part)] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in out) == pieces
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], SF)
