"""Similarity join on word n-grams by prefix lists, with skipping by set relations.

A document's set is that of its SIZE-word shingles.  All sets are kept in one global order of shingles, the frequent ones last; two sets
of Jaccard similarity 0.8 or more share a shingle among the first n - ceil(0.8 n) + 1 of each.  An inverted list of those prefix
shingles therefore meets each linked pair.

Relations between sets save most of the work:
  * equal sets are one set: only its representative is listed;
  * a list is cut into blocks by set size and position, and two blocks whose sizes or positions lie too far apart are skipped whole; the
    blocks of a list of more than LONG entries are dealt to tasks by pairs;
  * in a first round each set meets one pivot only, that with which it shares most lists.  What is then known of two sets and their common
    pivot bounds their own overlap: overlap(A, X) + overlap(Y, X) - |X| <= overlap(A, Y) <= overlap(A, X) + |Y| - overlap(Y, X).
    So most answers of a set follow from those of the set it resembles, and only pairs that stay open, in different components, are
    counted out on the sets themselves.
Links within a component need not be found again, as the result is the component.

The order of shingles affects the work, never the result.  Shingles found at least LOCAL times within some block of a task's documents are
counted over all documents, and the most frequent of them (HEAVY at most) are sent to all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, REQUEST, answers, begin, discard, free_name, flags, hashed_texts, in_groups, materialised, release, replies, request_rows, request_table, small_batches, spread, text_bytes, texts, windows, with_one
from .components import components
from .urls import LANES, MOST_BLOCKS, bits, bloom_filter

SIZE = 5
HEAVY, LOCAL, COUNT_BLOCK = 1 << 17, 4, 3_000_000
FIRST_HEAVY = np.int64(1 << 62)
KEYS_PER_BUCKET = 1_500_000
LIST_BLOCK = 1024
#: Entries of a list that one task holds; pairs of one set that one task counts out.
LONG, MOST_PAIRS = 50_000, 1_000
#: Bytes kept of a shingle's hash for counting overlaps of two sets.
WIDTH = 6


def shingle_sets(values: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, an empty one has none."""
    out = []
    for hashes in hashed_texts([v.lower() for v in values]):
        out.append(np.unique(windows(hashes, min(size, len(hashes)))) if len(hashes) else hashes)
    return out


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes: 100 o >= 80 (n + m - o)."""
    return -(-(4 * (n + m)) // 9)


def prefix_length(n):
    return n - -(-4 * n // 5) + 1


class Order:
    """The global order of shingles: the frequent ones last, by frequency; all others by hash."""

    BITS = 22

    def __init__(self, heavy: np.ndarray, rank: np.ndarray):
        self.heavy, self.rank = heavy, rank
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[self.slot(heavy)] = True

    def slot(self, s: np.ndarray) -> np.ndarray:
        return (s >> np.uint64(64 - self.BITS)).astype(np.int64)

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles that aren't frequent, and the places of those that are."""
        often = self.maybe[self.slot(s)]
        some = np.flatnonzero(often)
        if not len(some):
            return s, some
        at = np.minimum(np.searchsorted(self.heavy, s[some]), len(self.heavy) - 1)
        real = self.heavy[at] == s[some]
        often[some[~real]] = False
        return s[~often], at[real]

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """Order keys of the prefix of a set.  Hash order goes through the sorted set from its start, so mostly a part of it is enough."""
        p = prefix_length(len(s))
        rare, _ = self.split(s[: 2 * p])
        often = ()
        if len(rare) < p:
            rare, often = self.split(s)
        keys = (rare[:p] >> np.uint64(2)).astype(np.int64)
        if len(keys) < p:
            keys = np.concatenate([keys, np.sort(FIRST_HEAVY + self.rank[often])[: p - len(keys)]])
        return keys


def heavy_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the rank of each by frequency."""

    def count(batches):
        begin("jaccard")
        sets, size, seen = [], 0, set()
        for batch in batches:
            for s in shingle_sets(list(texts(batch.column(0)))):
                mark = xxhash.xxh3_64_intdigest(s.tobytes())
                if mark in seen:
                    continue
                seen.add(mark)
                sets.append(s)
                size += len(s)
                if size >= COUNT_BLOCK:
                    yield often(sets)
                    sets, size, seen = [], 0, set()
        if size:
            yield often(sets)
        release()

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= LOCAL
        return pa.record_batch([pa.array(keys[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64))], names=["key", "n"])

    counted = materialised(docs.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    # how many there are of each power of two (with four steps between) gives the least frequency to send
    step = F.floor(4 * F.log2("n")).cast("int")
    sizes = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).limit(400).collect()
    least, total = None, 0
    for r in sizes:
        if total + r["k"] > HEAVY:
            break
        total, least = total + r["k"], r["step"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    table = counted.filter(step >= least).toArrow()
    discard(counted)
    keys, n = table.column("key").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, n))] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], rank[order]


SETS = "row long, rid long, n int, sig binary, keys array<long>, listed int, last long, b0 long, b1 long, b2 long, b3 long"


def document_sets(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each document: its id, rid (a number of its own), n, sig (of its set); if another document may be linked to it also
    keys (prefix shingles that others' prefixes hold too, else -1), listed (how many), last (its last prefix shingle) and a bitmap of
    them."""
    rows = docs.select(id_col, row_key(id_col, text).alias("row"), F.col(text).alias("text"))
    size = text_bytes(rows, "text")
    shared = docs.sparkSession.sparkContext.broadcast(heavy_shingles(rows, "text"))
    grouped, _ = in_groups(rows, id_col, "text", size)
    buckets = max(1, math.ceil(size[1] / 6 / 4 / KEYS_PER_BUCKET))

    def read(table: pa.Table) -> tuple[list[np.ndarray], list[bytes], list[np.ndarray]]:
        sets = shingle_sets(list(texts(table.column("text"))))
        sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        order = Order(*shared.value)
        return sets, sigs, [order.prefix(s) for s in sets]

    def distinct_keys(sigs: list[bytes], prefixes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = dict(zip(sigs, prefixes, strict=True))
        # requests are dealt by the upper bits: keys of frequent shingles would all fall into one bucket
        return np.unique(spread(np.concatenate(list(own.values()))), return_counts=True)

    def ask(table: pa.Table) -> pa.Table:
        _, sigs, prefixes = read(table)
        keys, counts = distinct_keys(sigs, prefixes)
        release()
        return request_table(request_rows(table.column("__grp")[0].as_py(), keys, counts, buckets))

    kind = docs.schema[id_col].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(10)]
        if left.num_rows:
            left = left.sort_by([(id_col, "ascending")])
            sets, sigs, prefixes = read(left)
            keys, _ = distinct_keys(sigs, prefixes)
            twice = answers(right, 0, np.uint8).astype(bool)
            if len(twice) != len(keys):
                raise ValueError(f"{len(twice)} answers for {len(keys)} keys")
            group = left.column("__grp")[0].as_py()
            for i, (s, sig, prefix) in enumerate(zip(sets, sigs, prefixes, strict=True)):
                found = twice[np.searchsorted(keys, spread(prefix))]
                listed = len(prefix) and found.any()
                # positions of unlisted shingles matter too, so they stay as -1
                row = ((group << 32) + i, len(s), sig, np.where(found, prefix, -1) if listed else None, int(found.sum()) if listed else None, int(prefix[-1]) if listed else None, *(bitmap(prefix[found]) if listed else [None] * 4))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
        release()
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), *[pa.int64()] * 5]
        return pa.table({id_col: left.column(id_col), "row": left.column("row"), **{n: pa.array(c, t) for n, c, t in zip(["rid", "n", "sig", "keys", "listed", "last", *BITS], cols, types, strict=True)}})

    answered = replies(grouped.groupBy("__grp").applyInArrow(ask, REQUEST), flags)
    return grouped.groupBy("__grp").cogroup(answered.groupBy("__grp")).applyInArrow(finish, f"`{id_col}` {kind}, {SETS}")


def row_key(id_col: str, text: str):
    """The same for rows of equal id and text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.coalesce(F.col(text), F.lit("\0")))


def bitmap(keys: np.ndarray) -> list[int]:
    """256 bits, one of which each key sets."""
    bits = np.zeros(256, np.uint8)
    bits[(spread(keys) >> np.uint64(56)).astype(np.int64)] = 1
    return np.packbits(bits).view("<i8").tolist()


def narrow(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]).tobytes()


def widened(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // WIDTH, 8), np.uint8)
    out[:, 8 - WIDTH :] = np.frombuffer(b, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


BITS = ("b0", "b1", "b2", "b3")
PAIRS = "a long, b long, na int, nb int, a_first boolean, known boolean"


def pair_batch(a, b, na, nb, a_first, known) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(na, pa.int32()), pa.array(nb, pa.int32()), pa.array(a_first, pa.bool_()), pa.array(known, pa.bool_())], names=["a", "b", "na", "nb", "a_first", "known"])


def streamed(names: list[str], step):
    """A function over batches sorted by key (the first of names) that hands whole lists to ``step``: columns, and where lists start."""

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
                if held is not None:
                    columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
                starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
                # the last list may go on in the next batch
                yield from step([c[: starts[-1]] for c in columns], starts[:-1])
                held = [c[starts[-1] :] for c in columns]
        if held is not None:
            yield from step(held, np.zeros(1, np.int64))

    return run


def star_pairs(columns, starts):
    """Each set of a list with the list's pivot, unless size, position or what they list keeps them apart.

    The pivot is the set that lists most of its prefix: it has the fewest shingles of its own, as an original among edited copies has.
    """
    if not len(columns[0]):
        return
    key, rid, n, pos, last, listed, *bits = columns
    order = np.lexsort((rid, -listed, key))
    x = np.repeat(order[starts], np.diff(np.r_[starts, len(key)]))  # of each row, the row of its list's pivot
    bits = [b.view(np.uint64) for b in bits]
    near = (x != np.arange(len(key))) & possible(n[x], n, pos[x], pos) & enough(n[x], n, last[x], last, listed[x], listed, [b[x] for b in bits], bits)
    if near.any():
        x = x[near]
        yield pair_batch(rid[x], rid[near], n[x], n[near], last[x] <= last[near], np.zeros(len(x), bool))


def possible(n, m, i, j) -> np.ndarray:
    """Whether sets of sizes n and m that share the shingle at positions i and j can be linked: at most min(i, j) shared ones lie before."""
    most = np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1)
    return most >= needed(n, m)


def enough(n, m, last_n, last_m, listed_n, listed_m, bits_n, bits_m) -> np.ndarray:
    """Whether the listed shingles that two prefixes may share, and all that follows the prefix that ends first, would do.

    A bit that only one of two bitmaps has stands for a shingle at least that the other hasn't."""
    rest = np.where(last_n <= last_m, n - prefix_length(n), m - prefix_length(m))
    own = sum(np.bitwise_count(x & ~y).astype(np.int64) for x, y in zip(bits_n, bits_m, strict=True))
    other = sum(np.bitwise_count(y & ~x).astype(np.int64) for x, y in zip(bits_n, bits_m, strict=True))
    return np.minimum(listed_n - own, listed_m - other) + rest >= needed(n, m)


def open_pairs(columns, starts):
    """Pairs in different components that sizes, positions and what is known of their pivots leave open: of lists of two all at once,
    of longer ones block by block."""
    columns = [columns[0], *(c.astype(np.int64, copy=False) for c in columns[1:])]
    sizes = np.diff(np.r_[starts, len(columns[0])])
    two = starts[sizes == 2]
    if len(two):
        yield from open_among(columns, *by_size(columns, two, two + 1))
    for a, k in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        yield from open_in_list([c[a : a + k] for c in columns])


def by_size(columns, i, j):
    """Pairs of rows with the smaller set first."""
    swap = columns[2][i] > columns[2][j]
    return np.where(swap, j, i), np.where(swap, i, j)


def open_in_list(columns):
    order = np.lexsort((columns[3], columns[2]))
    columns = [c[order] for c in columns]
    _, rid, n, pos, *_ = columns
    comp = columns[10]
    for x in range(0, len(rid), LIST_BLOCK):
        own = slice(x, x + LIST_BLOCK)
        for y in range(0, x + 1, LIST_BLOCK):
            other = slice(y, min(y + LIST_BLOCK, len(rid)))
            # blocks are in order of size: the other's largest may be too small for the own smallest
            if 5 * n[other][-1] < 4 * n[own][0]:
                continue
            if (comp[own] == comp[own][0]).all() and (comp[other] == comp[own][0]).all():
                continue
            far = max(pos[own].min() - pos[other].max(), pos[other].min() - pos[own].max())
            if far > 0 and n[own][-1] - far < needed(n[other][0], n[own][0]):
                continue
            i, j = np.nonzero((comp[other][:, None] != comp[own][None, :]) & possible(n[other][:, None], n[own][None, :], pos[other][:, None], pos[own][None, :]))
            i, j = i + y, j + x
            if x == y:
                i, j = i[i < j], j[i < j]
            yield from open_among(columns, i, j)


def open_among(columns, i, j):
    """Of the rows i and j, those pairs that stay open; n[i] <= n[j]."""
    _, rid, n, pos, last, listed, b0, b1, b2, b3, comp, pivot, overlap, pivot_n, side = columns
    bits = [b.view(np.uint64) for b in (b0, b1, b2, b3)]
    stay = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 0)) & possible(n[i], n[j], pos[i], pos[j])
    i, j = i[stay], j[stay]
    stay = enough(n[i], n[j], last[i], last[j], listed[i], listed[j], [b[i] for b in bits], [b[j] for b in bits])
    i, j = i[stay], j[stay]
    need = needed(n[i], n[j])
    same = (pivot[i] == pivot[j]) & (pivot[i] >= 0)
    most = np.where(same, np.minimum(overlap[i] + n[j] - overlap[j], overlap[j] + n[i] - overlap[i]), n[i])
    known = same & (overlap[i] + overlap[j] - pivot_n[i] >= need)
    # the pivot's own links are counted out already
    done = (pivot[i] == rid[j]) | (pivot[j] == rid[i])
    stay = (most >= need) & ~done
    i, j, known = i[stay], j[stay], known[stay]
    if len(i):
        flip = rid[i] > rid[j]
        a, b = np.where(flip, j, i), np.where(flip, i, j)
        yield pair_batch(rid[a], rid[b], n[a], n[b], last[a] <= last[b], known)


def candidates(pairs: DataFrame) -> DataFrame:
    """Pairs that share enough of their prefixes: of the set whose prefix ends first, all the rest may be shared."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("a_first").alias("a_first"), F.max("known").alias("known"))
    rest = F.expr("CASE WHEN a_first THEN ceil(4 * na / 5) - 1 ELSE ceil(4 * nb / 5) - 1 END")
    return counted.filter(F.col("shared") + rest >= F.expr("ceil(4 * (na + nb) / 9)"))


def counted_out(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """a, b, overlap, linked, na (size of a's set), from the sets themselves; those of the sets in question are made anew from their texts."""
    rids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    asked = materialised(sets.join(rids, "rid", "left_semi").select("row", "rid"))
    keys = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    rows = docs.select(row_key(id_col, text).alias("row"), F.col(text).alias("text")).join(keys, "row").select("rid", "text")

    def make(batches):
        for batch in batches:
            elements = [narrow(s) for s in shingle_sets(list(texts(batch.column(1))))]
            yield pa.record_batch([batch.column(0), pa.array(elements, pa.binary())], names=["rid", "elements"])
        release()

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            x = [widened(v.as_py()) for v in get("x")]
            y = [widened(v.as_py()) for v in get("y")]
            overlap = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            n, m = np.array([len(p) for p in x]), np.array([len(q) for q in y])
            linked = 100 * overlap >= 80 * (n + m - overlap)
            yield pa.record_batch([get("a"), get("b"), pa.array(overlap, pa.int32()), pa.array(linked, pa.bool_()), pa.array(n, pa.int32())], names=["a", "b", "overlap", "linked", "na"])

    made = materialised(rows.mapInArrow(make, "rid long, elements binary"))
    both = with_elements(with_elements(pairs.select("a", "b"), made, "a", "x"), made, "b", "y")
    out = materialised(both.select("a", "b", "x", "y").mapInArrow(count, "a long, b long, overlap int, linked boolean, na int"))
    discard(made, asked)
    return out.dropDuplicates(["a", "b"])


def with_elements(pairs: DataFrame, made: DataFrame, end: str, name: str) -> DataFrame:
    """pairs with the elements of the set at one end.  A set in more than MOST_PAIRS pairs has a copy for each so many of them."""
    often = materialised(pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / MOST_PAIRS).alias("copies")).filter("copies > 1"))
    many = often.count()
    own = made.select(F.col("rid").alias(end), F.col("elements").alias(name))
    if not many:
        return pairs.join(own, end)
    known = F.broadcast(often) if many <= MOST_BROADCAST else often
    copies = F.coalesce("copies", F.lit(1))
    other = F.col("b" if end == "a" else "a")
    own = own.join(known, end, "left").select(end, name, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    return pairs.join(known, end, "left").withColumn("copy", F.pmod(F.xxhash64(other), copies)).join(own, [end, "copy"]).drop("copy", "copies")


def long_lists(postings: DataFrame) -> DataFrame | None:
    """key, parts of the lists of more than LONG entries, if there are any."""
    long = materialised(postings.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LONG).alias("parts")).filter("parts > 1"))
    return long if long.count() else None


def parted(postings: DataFrame, long: DataFrame | None) -> DataFrame:
    """Lists with LONG entries or so; a part of a longer one is a list of its own, which is enough to meet pivots."""
    if long is None:
        return postings
    part = F.xxhash64("key", F.pmod(F.xxhash64("rid"), F.col("parts")))
    return with_one(postings, long, "key").withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(part)).drop("parts")


def in_block_pairs(state: DataFrame, long: DataFrame | None) -> DataFrame:
    """Lists in which all pairs of entries meet that can be open, with side 0; a long list becomes lists of two blocks, sides 1 and 2.

    Blocks are made by set size (sizes of linked sets differ by a quarter at most, so only blocks of the same or of neighbouring size
    classes meet) and by whether an entry is in the list's largest component, whose entries needn't meet one another."""
    if long is None:
        return state.withColumn("side", F.lit(0))
    marked = materialised(with_one(state, long, "key"))
    short = marked.filter("parts is null").drop("parts").withColumn("side", F.lit(0))
    rest = marked.filter("parts is not null").drop("parts")
    largest = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    sized = with_one(rest, largest, "key").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(1.25))).withColumn("in_largest", F.col("comp") == F.col("largest"))
    held = sized.groupBy("key", "size", "in_largest").agg(F.ceil(F.count(F.lit(1)) / (LONG / 2)).alias("salts"))
    blocks = materialised(held.select("key", "size", "in_largest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "salts"))
    block = F.struct("size", "in_largest", "salt")
    one, two = blocks.select("key", block.alias("one")), blocks.select("key", block.alias("two"))
    met = one.join(two, "key").filter("one <= two and two.size - one.size <= 1 and not (one.in_largest and two.in_largest)").withColumn("list", F.xxhash64("key", "one", "two"))
    sides = met.select("key", "one.*", "list", F.when(F.col("one") == F.col("two"), 0).otherwise(1).alias("side")).unionByName(met.filter("one <> two").select("key", "two.*", "list", F.lit(2).alias("side")))
    sides = sides.join(blocks, ["key", "size", "in_largest", "salt"]).groupBy("key", "size", "in_largest", "salts").agg(F.collect_list(F.struct("salt", "list", "side")).alias("lists"))
    placed = sized.join(sides, ["key", "size", "in_largest"]).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("salts")))
    placed = placed.withColumn("x", F.explode(F.filter("lists", lambda x: x["salt"] == F.col("own"))))
    return short.unionByName(placed.withColumn("key", F.col("x.list")).withColumn("side", F.col("x.side")).select(*short.columns))


def grouped_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id_col, row, rid, n_shingles, root (a number of the component; null without shingles) and least (its smallest id) of each row."""
    small_batches(docs.sparkSession)
    sets = materialised(document_sets(docs, id_col, text))
    reps = materialised(sets.filter("n > 0").groupBy("sig").agg(F.min("rid").alias("rep"), F.min(id_col).alias("least")))
    listed = sets.filter("keys is not null").join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi")
    postings = materialised(listed.select("rid", "n", "last", "listed", *BITS, F.posexplode("keys").alias("pos", "key")).filter("key >= 0").select("key", "rid", "n", "pos", "last", "listed", *BITS))
    long = long_lists(postings)
    lists = lambda df: df.repartition("key").sortWithinPartitions("key", "rid")
    stars = lists(parted(postings, long)).mapInArrow(streamed(["key", "rid", "n", "pos", "last", "listed", *BITS], star_pairs), PAIRS)
    best = materialised(candidates(stars).groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")))
    first = counted_out(best, sets, docs, id_col, text)
    links = first.filter("linked").select("a", "b")
    roots = components(links)
    # what is known of each set now: its component, and its overlap with its pivot
    met = first.select(F.col("b").alias("rid"), F.col("a").alias("pivot"), "overlap", F.col("na").alias("pivot_n"))
    found = materialised(roots.select(F.col("node").alias("rid"), "root").join(met, "rid", "full"))
    known = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    state = postings.join(known, "rid", "left").select("key", "rid", "n", "pos", "last", "listed", *BITS, F.coalesce("root", "rid").alias("comp"), F.coalesce("pivot", F.lit(-1)).alias("pivot"), F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("pivot_n", F.lit(0)).alias("pivot_n"))
    # a list must be whole in one task: nothing before this shuffle may be dealt by key, else the shuffle would be left out
    opened = lists(in_block_pairs(state, long)).mapInArrow(streamed(["key", "rid", "n", "pos", "last", "listed", *BITS, "comp", "pivot", "overlap", "pivot_n", "side"], open_pairs), PAIRS)
    pairs = materialised(candidates(opened))
    discard(postings, found)
    more = counted_out(pairs.filter("not known"), sets, docs, id_col, text).filter("linked").select("a", "b")
    roots = components(links.unionByName(more).unionByName(pairs.filter("known").select("a", "b")))
    # the smallest id of each component of two sets or more
    members = materialised(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(reps.select(F.col("rep").alias("node"), "least"), "node"))
    least = materialised(members.groupBy("root").agg(F.min("least").alias("least")))
    named = with_one(members.drop("least"), least, "root").withColumnRenamed("node", "rep")
    rooted = materialised(reps.withColumnRenamed("least", "own").join(named, "rep", "left").select("sig", F.coalesce("root", "rep").alias("root"), F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("least")).alias("least")))
    rows = sets.select(id_col, "row", "rid", F.col("n").cast("long").alias("n_shingles"), "sig")
    some = with_one(rows.filter("n_shingles > 0"), rooted, "sig").drop("sig")
    none = rows.filter("n_shingles = 0").select(id_col, "row", "rid", "n_shingles", F.lit(None).cast("long").alias("root"), F.col(id_col).alias("least"))
    return some.unionByName(none)


def join_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for each row of docs.

    Words have A-Z lower-cased.  Two documents are linked when 100 * |intersection| >= 80 * |union| of their shingle sets; component_id
    is the smallest id that links reach, the row's own included.  Null, empty or blank text: no shingles and no links, component_id is
    the row's own id.  Null ids take part and get the smallest id that isn't null, if any.  Repeated ids and rows are documents of their
    own (and so linked if not empty).  Other columns are ignored.  An empty table gives an empty result.  Whole texts are read.
    """
    return grouped_rows(docs, id_col, text).select(id_col, "n_shingles", F.col("least").alias("component_id"))


def has_words(text: str) -> Column:
    return F.octet_length(F.ltrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) > 0


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id, a null id last, and among equal ids any.

    Rows without words all stay, repeated ones too.  Of rows that are equal in id and text, and have words, one stays: that whose other
    columns have the smallest hash.  All columns pass through unchanged, whatever their names.  An empty table gives an empty result.
    """
    found = materialised(grouped_rows(docs, id_col, text))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("rid"))
    some = found.filter("root is not null")
    first = some.groupBy("root").agg(F.min_by("row", order).alias("row"))
    marks = some.select("row", F.lit(0).alias("kept")).unionByName(first.select("row", F.lit(1).alias("kept")))
    keys = materialised(marks.groupBy("row").agg((F.max("kept") == 1).alias("kept"), (F.count_if(F.col("kept") == 0) > 1).alias("repeated")))
    discard(found)
    # texts stay where they are: what a filter of the keys that go (or are repeated) doesn't hold is kept, only the rest is looked up
    held, blocks = bloom_filter(keys.filter("not kept or repeated"), "row", MOST_BLOCKS)
    held = materialised(held)
    asked = materialised(probed(keys.filter("kept"), "row", held, blocks, True).select("row", "repeated"))
    row, rest = free_name("__row", docs), free_name("__rest", docs)
    keyed = docs.withColumn(row, F.when(has_words(text), row_key(id_col, text)))
    known = asked.select(F.col("row").alias(row))
    out = probed(keyed, row, held, blocks, True).join(F.broadcast(known) if asked.count() <= MOST_BROADCAST else known, row, "left_semi")
    names = [f"`{c}`" for c in docs.columns]
    if asked.filter("repeated").limit(1).count():
        least = F.xxhash64(*[F.to_json(F.struct(c)) for c in names])
        out = out.groupBy(row).agg(F.min_by(F.struct(*names), least).alias(rest)).select(f"{rest}.*")
    discard(keys)
    return out.select(*names).unionByName(probed(keyed, row, held, blocks, False).select(*names))


def probed(rows: DataFrame, key: str, held: DataFrame, blocks: int, hit: bool) -> DataFrame:
    """Those rows whose key a Bloom filter lets through (hit), or all others; a null key isn't let through."""
    of, words = free_name("__block", rows), free_name("__words", rows)
    held = held.select(F.col("block").alias(of), F.struct(*[F.col(f"word{i}") for i in range(LANES)]).alias(words))
    set_all = F.col(key).isNotNull()
    for i, b in enumerate(bits(F.xxhash64(key, F.lit(1)))):
        set_all = set_all & (F.col(f"{words}.word{i}").bitwiseAND(b) != 0)
    out = rows.join(F.broadcast(held), F.pmod(F.xxhash64(key), F.lit(blocks)) == F.col(of), "left")
    return out.filter(F.coalesce(set_all, F.lit(False)) == hit).drop(of, words)


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_similar(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
