"""Operators on documents against brute force, on a table of odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sedimenta.llm.jaccard import join_similar, keep_one
from sedimenta.llm.language import fold, identify
from sedimenta.llm.lm import MU, score
from sedimenta.llm.packing import best_two_fit, pack, tokenizer
from sedimenta.llm.pieces import CharacterMap, encode, model
from sedimenta.llm.quality import quality_rules
from sedimenta.llm.substrings import drop_repeats

from .cases import documents, edited, empty, prose, table, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = documents()
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def lower(t):
    return (t or "").encode().lower().decode()


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def shingle_set(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows):
    """Root of each row by number, by comparing all pairs."""
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_similarity_join(spark):
    sets, roots = classes(ROWS)
    least = defaultdict(list)
    for r, root in zip(ROWS, roots, strict=True):
        if r[0] is not None:
            least[root].append(r[0])
    want = multiset((r[0], len(s), (min(least[root]) if least[root] else None) if s else r[0]) for r, s, root in zip(ROWS, sets, roots, strict=True))
    assert multiset(join_similar(with_clashes(table(spark))).collect()) == want
    assert join_similar(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    sets, roots = classes(ROWS)
    kept = keep_one(with_clashes(table(spark)))
    assert kept.columns == with_clashes(table(spark)).columns
    got = kept.select("doc_id", "text").collect()
    with_words = [r for r in got if shingle_set(r[1])]
    assert len(with_words) == len({root for root, s in zip(roots, sets, strict=True) if s})
    assert multiset(r for r in got if not shingle_set(r[1])) == multiset((r[0], r[1]) for r in ROWS if not shingle_set(r[1]))


@pytest.mark.parametrize("more", [[], [(9, "two words", "en", "a", 0)] * 2])
def test_repeated_rows_without_words_stay(spark, more):
    rows = [(1, " ", "en", "a", 0), (1, " ", "en", "b", 0), (2, None, "en", "a", 0), (9, "two words", "en", "a", 0), *more]
    out = keep_one(table(spark, rows).withColumn("__row", F.lit("mine")))
    assert multiset((r["doc_id"], r["text"], r["__row"]) for r in out.collect()) == multiset([(1, " ", "mine")] * 2 + [(2, None, "mine"), (9, "two words", "mine")])


def test_rows_of_equal_id_and_text_leave_the_same_one(spark):
    rows = [(9, "two words", lang, "a", n) for n, lang in enumerate(["en", "de", "fr"] * 5)]
    found = {tuple(map(tuple, keep_one(table(spark, order)).collect())) for order in (rows, rows[::-1])}
    assert len(found) == 1 and len(found.pop()) == 1


def test_texts_of_kept_rows_are_not_dealt_out(spark, monkeypatch):
    """More rows stay than may be broadcast; those that go are few."""
    from sedimenta.llm import jaccard

    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, prose(2000 + i // 2 if i < 10 else 2000 + i, 20), "en", "a", i) for i in range(80)] + [(90, None, "en", "a", 0)]
        out = keep_one(table(spark, rows))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in out.collect()) == [*range(0, 10, 2), *range(10, 80), 90]
        assert "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("most_blocks", "most_broadcast"), [(1, 0), (1, 200_000), (1 << 16, 0)])
def test_one_of_each_group_stays_whatever_the_filter_lets_through(spark, monkeypatch, most_blocks, most_broadcast):
    """A filter of one full block lets nearly all through, which are then looked up; repeated rows, some with a null id, are among them."""
    from sedimenta.llm import jaccard

    monkeypatch.setattr(jaccard, "MOST_BLOCKS", most_blocks)
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", most_broadcast)
    texts = {i: prose(3000 + i, 20) for i in range(300)}
    rows = [(1000 * k + i, t, "en", "a", k) for i, t in texts.items() for k in range(1 + i % 3)]
    rows += [(i, texts[i], "de", "b", 9) for i in range(40)] + [(None, prose(4000, 20), "en", "a", 0)] * 2 + [(7, " ", "en", "a", 0)] * 2
    got = keep_one(table(spark, rows)).collect()
    assert multiset((r["doc_id"], r["text"]) for r in got) == multiset([*texts.items(), (None, prose(4000, 20)), (7, " "), (7, " ")])
    assert not multiset(map(tuple, got)) - multiset(rows)


DENSE = [(i, edited(prose(50, 150), 100 + i, i % 14), "en", "a", 0) for i in range(160)] + [(500 + i, prose(50, 150), "en", "a", 0) for i in range(60)]


def check_components(spark, rows):
    _, roots = classes(rows)
    want = {}
    for r, root in zip(rows, roots, strict=True):
        want.setdefault(root, r[0])
    got = {r[0]: r[2] for r in join_similar(table(spark, rows)).collect()}
    assert got == {r[0]: want[root] for r, root in zip(rows, roots, strict=True)}


def test_similarity_join_on_a_dense_group(spark):
    """Copies at all distances, where links through others matter, and one large group of exact copies."""
    check_components(spark, DENSE)


def test_similarity_join_when_lists_pivots_and_joins_are_split(spark, monkeypatch):
    from sedimenta.llm import common, components, jaccard

    monkeypatch.setattr(jaccard, "LONG", 12)
    monkeypatch.setattr(jaccard, "MOST_PAIRS", 5)
    monkeypatch.setattr(common, "MOST_HOT", 20)
    for module in (common, components, jaccard):
        monkeypatch.setattr(module, "MOST_BROADCAST", 0)
    check_components(spark, DENSE + [(1000 + i, prose(900 + i, 30 + i) + " " + prose(51, 25), "en", "a", 0) for i in range(30)])


def test_substrings(spark):
    windows = Counter()
    words = [WORD.findall(r[1] or "") for r in ROWS]
    for w in words:
        windows.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(ROWS, words, strict=True):
        gone = {j for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    out = drop_repeats(with_clashes(table(spark)))
    assert multiset(out.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == want
    assert drop_repeats(empty(spark)).count() == 0


def base_rules(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(win)
    repeated = {j for i, x in enumerate(win) if seen[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(w) < 20 or 100 * len(repeated) > 30 * len(w)


def test_quality_base_rules(spark):
    out = quality_rules(with_clashes(table(spark)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert multiset(out.select("doc_id", *names).collect()) == multiset((r[0], *base_rules(r[1])) for r in ROWS)
    assert out.filter("kept and base_failed").count() == 0
    assert quality_rules(empty(spark)).count() == 0


def test_quality_frequent_lines(spark):
    from .cases import prose

    common = "Subscribe 42 to our  newsletter today and never miss a story from all of our many friends and writers"
    rows = [(i, prose(1000 + i, 40) + "\n" + common.replace("42", str(i)), "en", "a", 0) for i in range(30)]
    rows += [(100, "\n".join([common] * 2 + ["only this is mine"]), "en", "a", 0), (101, common + "\n" + prose(5, 40), "en", "b", 0)]
    rows += [(200 + i, prose(77, 30), "en", "a", 0) for i in range(40)]  # copies are one document
    out = {r["doc_id"]: r for r in quality_rules(table(spark, rows), least=5, share=0.2).collect()}
    assert all(out[i]["kept"] and out[i]["removed_words"] == 19 for i in range(30))
    assert not out[100]["kept"] and out[101]["removed_words"] == 0
    assert all(out[200 + i]["kept"] and out[200 + i]["removed_words"] == 0 for i in range(40))


def test_quality_documents_that_share_their_smallest_line(spark):
    common = "Subscribe to our newsletter today and never miss a story from all of our many friends and writers"
    rows = [(i, f"# menu\n{prose(1000 + i, 40)}\n{common}", "en", "a", 0) for i in range(30)]
    rows += [(100 + i, f"# shop\n{prose(77, 40)}", "en", "a", 0) for i in range(30)]  # copies are one document
    out = {r["doc_id"]: r["removed_words"] for r in quality_rules(table(spark, rows), least=5, share=0.2).collect()}
    assert out == {**{i: 20 for i in range(30)}, **{100 + i: 0 for i in range(30)}}


def test_quality_share_is_of_distinct_documents(spark):
    common = "Subscribe to our newsletter today and never miss a story from all of our many friends and writers"
    rows = [(i, f"{prose(1000 + i, 40)}\n{common}", "en", "a", 0) for i in range(20)] + [(100 + i, prose(77, 40), "en", "a", 0) for i in range(100)]
    out = {r["doc_id"]: r["removed_words"] for r in quality_rules(table(spark, rows), least=5, share=0.2).collect()}
    assert out == {**{i: 18 for i in range(20)}, **{100 + i: 0 for i in range(100)}}


def judged(rows, least, share):
    """removed_words and kept of each row, by counting distinct texts."""
    plain = lambda x: " ".join(WORD.findall(re.sub("[0-9]+", "0", x.lower())))
    lines = [[plain(x) for x in (r[1] or "").split("\n") if plain(x)] for r in rows]
    holders, texts_of = defaultdict(set), defaultdict(set)
    for r, own in zip(rows, lines, strict=True):
        texts_of[r[3]].add(r[1] or "")
        for x in own:
            holders[r[3], x].add(r[1] or "")
    out = []
    for r, own in zip(rows, lines, strict=True):
        gone = sum(len(x.split(" ")) for x in own if len(holders[r[3], x]) > max(least, share * len(texts_of[r[3]])))
        n, *_, failed = base_rules(r[1])
        out.append((r[0], gone, not failed and not (gone and (n - gone < 20 or n - gone < 0.3 * n))))
    return out


@pytest.mark.parametrize("limits", [{}, {"least": 3, "share": 0.1}])
def test_quality_verdicts(spark, limits):
    from sedimenta.llm.quality import LEAST, SHARE

    lines = ["# menu", "accept 12 cookies and read our terms", "zzz all rights reserved by the owners of these pages since 1999", "one two three"]
    rows = [(i, "\n".join([*lines[: i % 5], prose(3000 + i, 5 + i % 60), *lines[i % 4 :]]), "en", ["a", "b", None][i * i % 3], 0) for i in range(150)]
    rows += [(1000 + i, rows[i % 7][1], "en", "a", 0) for i in range(90)] + ROWS
    out = quality_rules(with_clashes(table(spark, rows)).withColumn("__row", F.lit("mine")).withColumn("__words", F.lit("mine")), **limits)
    want = judged(rows, limits.get("least", LEAST), limits.get("share", SHARE))
    assert multiset(out.select("doc_id", "removed_words", "kept").collect()) == multiset(want)
    assert sum(gone > 0 for _, gone, _ in want) > 50 and {k for _, gone, k in want if gone} == {True, False}
    assert out.select("__row", "__words").distinct().collect() == [("mine", "mine")]


def model_by_hand(rows, held, mu):
    """Scores by the definition, with the contexts as tuples; 1 is the begin, 0 the end."""
    texts = [[1, *WORD.findall(lower(r[1])), 0] for r in rows]
    seen, contexts = Counter(), Counter()
    for t, out in zip(texts, held, strict=True):
        if not out:
            for i in range(1, len(t)):
                for n in range(min(len(mu), i) + 1):
                    seen[tuple(t[i - n : i + 1])] += 1
                    contexts[tuple(t[i - n : i])] += 1
    total, distinct = contexts[()], sum(len(k) == 1 for k in seen)
    base = lambda x: (seen[x,] + 0.5) / (total + 0.5 * (distinct + 1))

    def likely(h, x):
        if not h:
            return base(x)
        c = contexts[h]
        return (seen[*h, x] + mu[len(h) - 1] * likely(h[1:], x)) / (c + mu[len(h) - 1]) if c else likely(h[1:], x)

    def line(r, t, out):
        own = sum(math.log10(likely(tuple(t[max(0, i - len(mu)) : i]), t[i])) for i in range(1, len(t)))
        return r[0], out, len(t) - 1, sum(seen[x,] > 0 for x in t[1:]), total, round(sum(math.log10(base(x)) for x in t[1:]), 6), round(own, 6)

    return Counter(line(r, t, out) for r, t, out in zip(rows, texts, held, strict=True)), likely, seen, contexts


@pytest.mark.parametrize("mu", [MU, (40.0,), (2.0, 1.0, 0.5)])
def test_language_model(spark, mu):
    rows = ROWS + [(2000 + i, "a b c a b d a b c e", "en", "a", 0) for i in range(20)] + [(2100, "d a b c zz a", "en", "a", 0)]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    want, likely, seen, contexts = model_by_hand(rows, held, mu)
    got = score(with_clashes(table(spark, rows)).drop("n_words"), fold() == 1, order=len(mu) + 1, mu=mu).collect()
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got) == want
    # the weights of a state add up to one, with a share for words never seen
    words = [k[0] for k in seen if len(k) == 1]
    for h in ((), (1,), ("a",), ("a", "b")[-len(mu) :], ("never seen",)):
        assert abs(sum(likely(h, x) for x in words) + likely(h, "never seen") - 1) < 1e-9


def test_language_model_without_rows_or_training(spark):
    assert score(empty(spark), fold() == 1).count() == 0
    out = score(table(spark), F.lit(True)).agg(F.sum("train_tokens"), F.sum("n_known"), F.max(F.abs("score"))).first()
    assert tuple(out) == (0, 0, 0.0)


def test_parts_of_a_text_are_read_from_the_right_state(monkeypatch):
    from sedimenta.llm import lm

    run, place = lm.token_runs([("a b c a b d b c a a b c " * 30).encode(), b"b c a", b""])
    grams = lm.grams_of(run, place, 3)
    numbers = [np.unique(k, return_inverse=True)[1] for _, k in grams]
    rng = np.random.default_rng(1)
    counts = [np.bincount(n) for n in numbers]
    counts[2] = np.where(rng.random(len(counts[2])) < 0.4, 0, counts[2])
    automaton = lm.Automaton(grams, numbers, counts, len(run), 400, 5, 3, lm.MU)
    whole = automaton.walk(place)
    monkeypatch.setattr(lm, "PART", 7)
    assert np.allclose(whole, automaton.walk(place), rtol=1e-12)


def test_language(spark):
    rng = np.random.default_rng(1)
    stems = {"en": "the of and ing tion with that".split(), "de": "der die und sch keit ung ein".split(), "fr": "les des eau oux ère que tion".split()}
    rows = [(i, " ".join(rng.choice(stems[lang], 40)), lang, "a", 0) for i, lang in enumerate(list(stems) * 60)]
    rows += [(900, None, "en", "a", 0), (901, "", "en", "a", 0), (902, "12 34 !?", "en", "a", 0), (903, "x", None, "a", 0), (None, rows[0][1], None, "a", 0), (904, "the and with " * 300_000, None, "a", 0)]
    out = identify(with_clashes(table(spark, rows)), F.coalesce(fold() != 0, F.lit(True))).select("doc_id", "lang_pred", "score").collect()
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0
    assert by[None]["lang_pred"] == "en" and by[904]["lang_pred"] == "en" and by[903]["lang_pred"] in stems
    held = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert identify(empty(spark), F.lit(True)).count() == 0
    assert {r[0] for r in identify(table(spark), F.lit(False)).select("lang_pred").collect()} == {"und"}


def test_each_language_is_learned_however_large_its_documents(spark):
    rows = [(i, f"{'abc' * 40} " * 50, "one", "a", 0) for i in range(3)] + [(None, "xyz uvw " * 500, "two", "a", 0)] * 3 + [(9, "xyz", None, "a", 0)]
    out = identify(table(spark, rows), F.lit(True), sample_bytes=100)
    assert out.filter("doc_id = 9").first()["lang_pred"] == "two" and {r[0] for r in out.select("lang_pred").collect()} == {"one", "two"}


def test_code_lengths_match_the_definition():
    from sedimenta.llm.language import Trees, grams, prepared

    text = b"abracadabra abra"
    data = np.frombuffer(prepared(text), np.uint8)
    trees = Trees({("x", n): np.unique(grams(data, n), return_counts=True) for n in (1, 2, 3, 4)})
    counts = [Counter() for _ in range(5)]
    for i in range(3, len(data)):
        for n in range(1, 5):
            counts[n][bytes(data[i - n + 1 : i + 1])] += 1

    def bits(s, n):
        if n == 0:
            return 8.0
        followers = {k: v for k, v in counts[n].items() if k[:-1] == s[-n:-1]}
        if not followers:
            return bits(s, n - 1)
        total, q = sum(followers.values()), len(followers)
        return -math.log2(followers[s[-n:]] / (total + q)) if s[-n:] in followers else -math.log2(q / (total + q)) + bits(s, n - 1)

    for probe in (text, b"cadab", b"zz abra\xc3\xa9", b""):
        p = prepared(probe)
        want = sum(bits(p[: i + 1], 4) for i in range(3, len(p)))
        assert abs(trees.code_lengths([probe])[0, 0] - want) < 1e-6


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rows = ROWS + [(500, "<|endoftext|> A<|EndOfText|>b Don't stop. U.S.A.,, (x). É é İ", "en", "a", 0)]
    out = pack(with_clashes(table(spark, rows)), BPE, capacity=256).collect()
    want = Counter()
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for i, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256].tobytes()
            want[r[0], i, a, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((*r[:5], bytes(r["ids"])) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.05 * sum(r["length"] for r in out) / 256 + 1
    assert pack(empty(spark), BPE).count() == 0


def test_best_two_fit():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64, 1000):
        lengths = rng.integers(1, capacity + 1, 300)
        bins = best_two_fit(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) <= capacity for b in bins)
    # 6 alone leaves 4; 3 goes in, and 2 + 2 fit what 3 and the gap leave more tightly
    assert sorted(sorted(np.array([6, 3, 2, 2])[b]) for b in best_two_fit(np.array([6, 3, 2, 2]), 10)) == [[2, 2, 6], [3]]
    with pytest.raises(ValueError):
        best_two_fit(np.array([5]), 4)


def test_packing_composes_before_it_lowers():
    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(BPE), tokenizer(BPE)
    for text in ("H\u0331", "J\u030c a", "T\u0308", "xW\u030a.", "Y\u030a, Plain E\u0301 É"):
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_of_odd_words():
    import random

    from tokenizers import Tokenizer

    tok, words, draw = Tokenizer.from_file(BPE), tokenizer(BPE), random.Random(7)
    signs = "abcdeszABZ0123''..,,$#<|>_-~!`{}[]\\\"@\x7f\x1c\x1f\x80\x85\xa0\xad\xb5\xaa\xbaäößÿ÷×ÄÖÉéñşğİıſΣςσĳ字あ한①² \ṯ́̈"
    special = ["<|startoftext|>", "<|endoftext|>", "'s", "'re", "'ll", "'T", "'VE"]
    for _ in range(20_000):
        text = "".join(draw.choice(special) if draw.random() < 0.05 else draw.choice(signs) for _ in range(draw.randint(1, 9)))
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_repeated_long_documents_are_spread_over_groups(spark):
    rows = [(i, prose(7000 + i % 3, 2000), "en", "a", 0) for i in range(40)]
    out = pack(table(spark, rows), BPE, capacity=512, group=50)
    assert out.select(F.shiftright("sequence_id", 32)).distinct().count() > 5


def test_pieces(spark):
    m = model(PIECES)
    out = encode(with_clashes(table(spark)), PIECES).select("doc_id", "text", "ids", "spans", "decoded").collect()
    assert len(out) == len(ROWS) and encode(empty(spark), PIECES).count() == 0
    for r in out:
        text = r["text"] or ""
        ids = m.processor.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == m.processor.decode(ids)
        spans = np.frombuffer(r["spans"], "<u4").reshape(-1, 2)
        raw = text.encode()
        # spans are in order, without gaps, and hold what the pieces say
        assert b"".join(raw[a:b] for a, b in spans) == raw and (np.diff(spans[:, 0]) >= 0).all()
        for i, (a, b) in zip(ids, spans, strict=True):
            if not m.processor.is_byte(i) and not m.processor.is_control(i):
                held = raw[a:b].decode().replace(" ", "▁")
                assert m.processor.id_to_piece(i) in (held, "▁" + held)


def test_pieces_of_odd_texts_are_the_librarys():
    import random

    m, r = model(PIECES), random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "e\u0301", "漢", "\u3000", "▁", "😀", "the", "ing", "<s>", "<unk>", "<0x41>", "\x00", "\r"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        assert m.encode(text.encode())[2] == m.processor.encode(text, add_bos=True, add_eos=True)


def test_pieces_go_through_the_character_map(tmp_path):
    """A model with a character map: ids by way of this map are the library's, and spans lie in the text before it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from sedimenta.llm.pieces import Pieces

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    m = Pieces(str(tmp_path / "m.model"))
    for text in ("ﬁne ①② ｶﾞ Å", "  two   spaces ", "", " ", "Straße İ éx 　y", "plain"):
        ids, spans, same = m.encode(text.encode())
        assert same == m.processor.encode(text, add_bos=True, add_eos=True)
        assert (np.diff(spans[:, 0]) >= 0).all() and spans.max() <= len(text.encode())
    ids, spans, _ = m.encode("ﬁne".encode())
    assert spans[1:-1, 0].min() == 0 and spans[1:-1, 1].max() == 5
def test_character_map_is_the_librarys():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=False, add_dummy_prefix=False, escape_whitespaces=False)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(library.serialized_model_proto())
        own = CharacterMap(proto.normalizer_spec)
        for text in ("ﬁne ①② ｶﾞ Å", "", "éx 　y", "Straße İ", "plain"):
            mapped, source = own.mapped(text.encode())
            assert mapped.decode() == library.normalize(text)
            assert len(source) == len(mapped) and (np.diff(source) >= 0).all()


def test_digests_are_of_the_outputs(spark):
    row = encode(table(spark, [(1, "hello world", "en", "a", 0)]), PIECES).select(F.sha2("ids", 256), "ids").first()
    assert row[0] == hashlib.sha256(bytes(row[1])).hexdigest()
