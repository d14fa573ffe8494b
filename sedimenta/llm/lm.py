"""Scoring by an n-gram language model kept as a weighted backoff automaton.

States are the contexts that occur in training, down to the empty one.  An n-gram seen in training is an arc of its context's state with
weight log10 of (c(hw) + mu * p(w | shorter h)) / (c(h) + mu); for all other words the state has a failure arc of weight
log10(mu / (c(h) + mu)) to the state of the next shorter context.  The empty context knows each word: (c + 0.5) / (N + 0.5 (V + 1)),
which leaves a share for words never seen.  So the weights of a state add up to one.  A text is read once from left to right: from the
state that it carries, failure arcs are followed until a state has an arc for the token; their weights are added up, and the arc leads to
the next state.

The whole model is never in one place.  A group of documents asks for the counts of just the n-grams that it holds (the count exchange
of ``common``), and builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import REPLY, REQUEST, added_up, begin, counted, hashed_texts, in_groups, release, reply_table, request_rows, request_table, small_batches, texts, uncounted, windows
from .language import fold

#: Tokens of the longest n-grams, and how much a context of 1, 2, .. tokens trusts the shorter one.
ORDER, MU = 3, (300.0, 20.0)
#: Hashes of the begin and the end of a text; no word hashes to them but by chance.
BEGIN, END = np.uint64(0x5EED5EED0000001), np.uint64(0x5EED5EED0000002)
KEYS_PER_BUCKET = 1_500_000
#: Bits that the keys of n-grams of two tokens or more go without.
LOW = 8
#: Tokens that one text reads at most before its next part is read beside it.
PART = 512


def token_runs(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """begin, words, end of all texts, as hashes, and the place of each within its text."""
    runs = [np.concatenate([[BEGIN], words, [END]]).astype(np.uint64) for words in hashed_texts([v.lower() for v in values])]
    return np.concatenate(runs), np.concatenate([np.arange(len(r)) for r in runs])


def grams_of(run: np.ndarray, place: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order: the tokens that end an n-gram of their text (where the text is too short before, the begin counts once), and its key."""
    out = [(np.flatnonzero(place > 0), run[place > 0])]
    for n in range(2, order + 1):
        ends = np.flatnonzero(place >= n - 1)
        out.append((ends, windows(run, n)[ends - n + 1] & ~np.uint64((1 << LOW) - 1)))
    return out


class Automaton:
    """The part of the model that some texts reach, and the arcs that their tokens could take.

    run, place: as of ``token_runs``; grams: as of ``grams_of``; numbers[n-1]: of the n-gram that ends at each such token, its number
    among the distinct ones; counts[n-1]: of each number, how often training has it.
    States: 0 is the empty context, 1 the begin; then the distinct n-grams shorter than the order, by length and number.
    Arcs: the distinct n-grams by length and number, from the state of all their tokens but the last.
    """

    def __init__(self, grams: list, numbers: list[np.ndarray], counts: list[np.ndarray], size: int, tokens: int, distinct: int, begins: int, mu: tuple):
        order = len(counts)
        sizes = np.array([len(c) for c in counts])
        first_arc = np.cumsum(np.r_[0, sizes])
        first_state = 2 + first_arc
        #: of each token, by order, the arc that it would take
        self.arcs = np.full((order, size), -1, np.int64)
        for n in range(order):
            self.arcs[n, grams[n][0]] = first_arc[n] + numbers[n]
        self.weight, self.target = np.zeros(first_arc[-1]), np.zeros(first_arc[-1], np.int64)
        self.there = np.zeros(first_arc[-1], bool)
        self.length = np.r_[0, 1, np.repeat(np.arange(1, order), sizes[:-1])]
        self.fail, self.fail_weight = np.zeros(len(self.length), np.int64), np.zeros(len(self.length))

        likely = (counts[0] + 0.5) / (tokens + 0.5 * (distinct + 1))
        self.base = np.log10(likely)
        known = counts[0] > 0
        self.weight[: sizes[0]], self.there[: sizes[0]] = self.base, True
        self.target[: sizes[0]] = np.where(known, first_state[0] + np.arange(sizes[0]), 0) if order > 1 else 0
        times = np.r_[0, begins, np.concatenate(counts[:-1])] if order > 1 else np.array([0, begins])  # by state
        for n in range(1, order):
            # any token that ends the n-gram tells what it is made of
            one = np.empty(sizes[n], np.int64)
            one[numbers[n]] = grams[n][0]
            shorter = self.arcs[n - 1, one]  # without its first token
            context = np.where(grams_start(self.arcs, one, n), 1, 2 + self.arcs[n - 1, one - 1])
            total, share = times[context], mu[n - 1]
            seen = counts[n] > 0
            with np.errstate(divide="ignore"):
                arc = (counts[n] + share * likely[shorter - first_arc[n - 1]]) / (total + share)
                failed = np.where(total > 0, share / (total + share), 1) * likely[shorter - first_arc[n - 1]]
            likely = np.where(seen, arc, failed)
            own = slice(first_arc[n], first_arc[n + 1])
            self.weight[own], self.there[own] = np.log10(likely), seen
            self.target[own] = first_arc[n] + 2 + np.arange(sizes[n]) if n < order - 1 else 2 + shorter
            # the states of that length fail to those of their own tokens but the first
            self.fail_weight[context] = np.log10(share / (total + share))
            if n > 1:
                self.fail[context] = 2 + self.arcs[n - 2, one - 1]

    def walk(self, place: np.ndarray) -> np.ndarray:
        """log10 weight of each text.  All texts are read side by side, a token at a time; of a long one also its parts, each from the
        state that the tokens before it lead to, whatever came before those."""
        order = len(self.arcs)
        starts = np.flatnonzero(place == 0)
        ends = np.r_[starts[1:], len(place)]
        parts = -(-(ends - starts - 1) // PART)
        text = np.repeat(np.arange(len(starts)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = starts[text] + 1 + number * PART
        end = np.minimum(begin + PART, ends[text])
        ahead = np.where(number > 0, order - 1, 0)  # tokens that only lead to the state
        at, state = begin - ahead, np.where(number > 0, 0, 1)
        steps = end - at
        by = np.argsort(-steps, kind="stable")
        at, state, steps, ahead, text = at[by], state[by], steps[by], ahead[by], text[by]
        total = np.zeros(len(text))
        alive = np.searchsorted(-steps, -np.arange(1, (steps[0] if len(steps) else 0) + 1), side="right")
        for step, n in enumerate(alive.tolist()):
            here, now, sums = at[:n] + step, state[:n].copy(), np.zeros(n)
            left = np.arange(n)
            while len(left):
                s = now[left]
                arc = self.arcs[np.minimum(self.length[s], order - 1), here[left]]
                hit = self.there[arc]
                go = left[hit]
                sums[go] += self.weight[arc[hit]]
                now[go] = self.target[arc[hit]]
                left, s = left[~hit], s[~hit]
                sums[left] += self.fail_weight[s]
                now[left] = self.fail[s]
            state[:n] = now
            total[:n] += np.where(step >= ahead[:n], sums, 0)
        return np.bincount(text, total, len(starts))


def grams_start(arcs: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-grams (of n + 1 tokens) that end here have the begin alone before their last token."""
    return (arcs[0, ends - 1] < 0) if n == 1 else np.zeros(len(ends), bool)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER, mu: tuple = MU) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from the rows where ``held_out`` is not true and scores all.  Tokens: words of the text with A-Z lower-cased, then one end.
    n_known: tokens that training has seen; base_score: their log10 weights by the empty context alone; score: by the automaton.
    Null or empty text: the end alone.  Null or repeated ids and repeated rows are rows of their own.  Other columns are ignored.  An
    empty table gives an empty result; without training rows every token has weight one.  Texts of any length are read whole.
    Words are told apart by 64 bits of their hash, longer n-grams by 56.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    n_rows, n_bytes, begins = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    grouped, groups = in_groups(rows, id_col, "text", (n_rows, int(n_bytes)))
    most = max(1, math.ceil((int(n_bytes) / 6 + n_rows) / KEYS_PER_BUCKET))
    buckets = [max(1, math.ceil(most / 4))] + [most] * (order - 1)
    firsts = [sum(buckets[:i]) for i in range(order)]

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        begin("lm")
        run, place = token_runs(list(texts(table.column("text"))))
        return run, place, grams_of(run, place, order)

    def ask(table: pa.Table) -> pa.Table:
        group = table.column("__grp")[0].as_py()
        _, place, grams = read(table)
        learn = ~np.array(table.column("held_out").to_pylist(), bool)[np.cumsum(place == 0) - 1]
        out = []
        for n, (ends, own) in enumerate(grams):
            keys, number = np.unique(own, return_inverse=True)
            counts = np.bincount(number, learn[ends], len(keys)).astype(np.int64)
            out += request_rows(group, keys, counts, buckets[n], firsts[n], LOW if n else 0)
        release()
        return request_table(out)

    def reply(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked_by, ends, _, total, place = added_up(table)
        number = next(n for n in reversed(range(order)) if bucket >= firsts[n])
        parts = np.split(total[place], ends[:-1])
        out = reply_table([(g, bucket, number, len(p).to_bytes(8, "little") + counted(p)) for g, p in zip(asked_by, parts, strict=True)])
        release()
        return out

    def count_up(table: pa.Table) -> pa.Table:
        known = n = 0
        if table.column("bucket")[0].as_py() < buckets[0]:
            _, _, _, total, _ = added_up(table)
            known, n = int((total > 0).sum()), int(total.sum())
        return pa.table({"known": [known], "n": [n]})

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return result(left, *[np.zeros(0)] * 5)
        run, place, grams = read(left)
        answered = sorted(zip(right.column("bucket").to_pylist(), right.column("round").to_pylist(), right.column("answer").to_pylist(), strict=True))
        distinct, tokens = map(int, answered[0][2].split())
        numbers, counts = [], []
        for n, (_, own) in enumerate(grams):
            keys, number = np.unique(own, return_inverse=True)
            numbers.append(number)
            counts.append(np.concatenate([np.zeros(0, np.int64), *(uncounted(a[8:], int.from_bytes(a[:8], "little")) for _, r, a in answered if r == n)]))
            if len(counts[n]) != len(keys):
                raise ValueError(f"{len(counts[n])} counts for {len(keys)} keys")
        automaton = Automaton(grams, numbers, counts, len(run), tokens, distinct, begins, mu)
        starts = np.flatnonzero(place == 0)
        ends = np.r_[starts[1:], len(run)]
        sums = lambda x: np.add.reduceat(np.r_[0, x[numbers[0]]][np.cumsum(place > 0) * (place > 0)], starts)
        out = result(left, ends - starts - 1, sums((counts[0] > 0).astype(np.int64)), np.full(len(starts), tokens), sums(automaton.base), automaton.walk(place))
        release()
        return out

    def result(left: pa.Table, n_tokens, n_known, tokens, base, total) -> pa.Table:
        added = {"n_tokens": (n_tokens, pa.int64()), "n_known": (n_known, pa.int64()), "train_tokens": (tokens, pa.int64()), "base_score": (base, pa.float64()), "score": (total, pa.float64())}
        return pa.table({id_col: left.column(id_col), "held_out": left.column("held_out"), **{k: pa.array(v.astype(np.int64 if t == pa.int64() else float), t) for k, (v, t) in added.items()}})

    asked = grouped.groupBy("__grp").applyInArrow(ask, REQUEST)
    answered = asked.groupBy("bucket").applyInArrow(reply, REPLY)
    # the totals of all buckets, to every group: as an answer of bucket -1
    totals = asked.groupBy("bucket").applyInArrow(count_up, "known long, n long").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    both = F.concat_ws(" ", "known", "n").cast("binary")
    totals = totals.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("__grp"), F.lit(-1).alias("bucket"), F.lit(-1).alias("round"), both.alias("answer"))
    return grouped.groupBy("__grp").cogroup(answered.unionByName(totals).groupBy("__grp")).applyInArrow(finish, schema)


def op5_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fold() == 1)
