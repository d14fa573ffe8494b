"""Approximate nearest neighbours by additive quantisation.

A vector of unit length is the sum of one full-dimensional code word from each of several codebooks.  Codebooks are fitted on residuals
and then refined together by least squares; encoding is a beam search; a query scores codes by adding up table entries and dividing
by the stored norm of the decoded vector; the best of each part are then scored exactly on the original vectors.  By their scores and the
stored distance of each vector from its decoded one, rows that may still be nearer are known; these are checked exactly too, so that
within the cells that a query visits nothing is missed.

Rows are dealt into cells round centres, and a query visits the cells whose centres are nearest.  How many it visits is measured with
some of the queries on the sample: as many as hold FOUND of their true neighbours there.  Vectors in clusters need few cells, vectors without any structure nearly all.
A cell with many rows is split into parts and one with many visits into blocks of queries, by hashes, so no task gets more than about
PART rows and QUERY_BLOCK queries.  Vectors travel with their codes, once for each block of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, materialised, release, small_batches

#: Codebooks, words of each, beam of the encoding, vectors scored exactly for each query and part.
BOOKS, WORDS, BEAM, RERANK = 16, 256, 4, 128
#: Vectors that codebooks and centres are fitted on, about, and numbers in them at most.
SAMPLE, SAMPLE_NUMBERS = 6_000, 4_000_000
#: Cells at most, and the share of true neighbours in the sample that the visited cells shall hold.
MOST_CELLS, FOUND = 1_024, 0.99
PART, QUERY_BLOCK = 16_384, 4_096
#: Queries that the number of visits is measured with, about.
ASKED = 500
#: More than single precision loses in an estimate, and in an inner product of unit vectors.
LOOSE, CLOSE = 1e-3, 1e-4


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def matrix(column, dim: int) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, row by row in the same order of additions, so that equal vectors get equal scores."""
    return (unit(rows) * unit(query[None, :])).sum(1)


class Codebooks:
    def __init__(self, words: np.ndarray):
        self.words = words.astype(np.float32)  # books, words, dim

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, refine: int = 2, seed: int = 7) -> Codebooks:
        rng, x = np.random.default_rng(seed), x.astype(np.float32)
        words = max(1, min(words, len(x)))
        residual, found = x.copy(), []
        for _ in range(books):
            centres = residual[rng.choice(len(residual), words, replace=False)].copy()
            for _ in range(rounds):
                own = np.argmin((centres * centres).sum(1) - 2 * residual @ centres.T, 1)
                n = np.bincount(own, minlength=words)
                total = np.zeros_like(centres)
                np.add.at(total, own, residual)
                centres[n > 0] = total[n > 0] / n[n > 0, None]
                if (n == 0).any():
                    centres[n == 0] = residual[rng.choice(len(residual), (n == 0).sum())]
            own = np.argmin((centres * centres).sum(1) - 2 * residual @ centres.T, 1)
            residual = residual - centres[own]
            found.append(centres)
        self = cls(np.stack(found))
        for _ in range(refine):  # all books at once: least squares for the words, then new codes
            codes = self.encode(x)[0].astype(np.int64)
            flat = codes + np.arange(books) * words
            gram, right = np.zeros((books * words,) * 2, np.float32), np.zeros((books * words, x.shape[1]), np.float32)
            for i in range(books):
                np.add.at(right, flat[:, i], x)
                for j in range(books):
                    np.add.at(gram, (flat[:, i], flat[:, j]), 1)
            gram[np.diag_indices(len(gram))] += 0.5
            right += 0.5 * self.words.reshape(books * words, -1)
            self = cls(np.linalg.solve(gram, right).reshape(self.words.shape))
        return self

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (uint8 for each book), norms of the decoded vectors, and their distances from the vectors."""
        out = [self.encode_some(x[a : a + 512].astype(np.float32), beam) for a in range(0, len(x), 512)]
        books = len(self.words)
        codes = np.concatenate([o[0] for o in out]) if out else np.zeros((0, books), np.uint8)
        return codes, *(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.float32) for i in (1, 2))

    def encode_some(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, dim = x.shape
        residual, codes = x[:, None, :], np.zeros((n, 1, 0), np.int64)
        for centres in self.words:
            k = len(centres)
            size = residual.shape[1]
            error = (residual * residual).sum(2)[:, :, None] + (centres * centres).sum(1) - 2 * (residual.reshape(-1, dim) @ centres.T).reshape(n, size, k)
            flat = error.reshape(n, size * k)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            from_, word = best // k, best % k
            rows = np.arange(n)[:, None]
            residual = residual[rows, from_] - centres[word]
            codes = np.concatenate([codes[rows, from_], word[:, :, None]], 2)
        best = np.argmin((residual * residual).sum(2), 1)
        rows = np.arange(n)
        left = residual[rows, best]
        decoded = x - left
        return codes[rows, best].astype(np.uint8), *(np.sqrt((v * v).sum(1)).astype(np.float32) for v in (decoded, left))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries, books, words: the inner products."""
        return np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.words, optimize=True)


class Cells:
    def __init__(self, centres: np.ndarray, visited: int):
        self.centres, self.visited = centres, visited

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, k: int, asked: np.ndarray | None = None, rounds: int = 8, seed: int = 11) -> Cells:
        """Centres by k-means on unit vectors; the number of cells to visit by the true neighbours of queries, or of some of the vectors."""
        rng, x = np.random.default_rng(seed), x.astype(np.float32)
        cells = max(1, min(cells, len(x) // 4))
        centres = x[rng.choice(len(x), cells, replace=False)]
        for _ in range(rounds):
            own = np.argmax(x @ centres.T, 1)
            total = np.zeros_like(centres)
            np.add.at(total, own, x)
            size = np.sqrt((total * total).sum(1, keepdims=True))
            centres = np.where(size > 1e-6, total / np.maximum(size, 1e-6), centres)
        own = np.argmax(x @ centres.T, 1)
        asked = x[rng.choice(len(x), min(ASKED, len(x)), replace=False)] if asked is None else asked.astype(np.float32)
        near = asked @ x.T
        itself = near.argmax(1)  # at most one, since there are no copies
        near[np.arange(len(asked)), itself] = np.where((x[itself] == asked).all(1), -np.inf, near.max(1))
        k = min(k, len(x) - 1)
        if not k:
            return cls(centres, cells)
        best = np.argpartition(-near, k - 1, 1)[:, :k]
        rank = np.argsort(np.argsort(-(asked @ centres.T), 1, kind="stable"), 1)
        needed = np.take_along_axis(rank, own[best], 1)
        return cls(centres, min(cells, 1 + int(np.quantile(needed, FOUND, method="higher"))))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x.astype(np.float32) @ self.centres.T), 1, kind="stable")


def found_in_part(books: Codebooks, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, errors: np.ndarray, k: int, rerank: int):
    """query id, vec id, score of the k nearest in a part whose rows are in the order of ids."""
    # equal vectors get one code, so that they score alike to the last bit and the smaller ids go first
    rows = np.ascontiguousarray(vectors)
    _, first, same = np.unique(rows.view([("", f"V{rows.dtype.itemsize * rows.shape[1]}")]).ravel(), return_index=True, return_inverse=True)
    codes, scale, errors = codes[first], 1 / np.maximum(norms[first], 1e-9), errors[first]
    columns = [np.ascontiguousarray(codes[:, m]) for m in range(codes.shape[1])]
    rerank = min(max(rerank, k), len(ids))
    distinct = np.empty((len(first), rows.shape[1]), np.float32)
    for a in range(0, len(first), 4096):
        distinct[a : a + 4096] = unit(rows[first[a : a + 4096]])

    def exactly(query: np.ndarray, near: np.ndarray) -> np.ndarray:
        once, place = np.unique(same[near], return_inverse=True)
        return cosines(query, rows[first[once]])[place]

    for a in range(0, len(queries), 64):
        asked = unit(queries[a : a + 64])
        tables = books.tables(asked)
        inner = tables[:, 0][:, columns[0]]
        for m in range(1, len(columns)):
            inner += tables[:, m][:, columns[m]]
        score = (inner * scale)[:, same]
        score[query_ids[a : a + 64, None] == ids] = -np.inf
        limits = np.partition(score, len(ids) - rerank, 1)[:, len(ids) - rerank]
        inner += errors + LOOSE  # no vector's cosine is above this
        product = asked.astype(np.float32) @ distinct.T + CLOSE
        for i, (q, query_id, own, limit) in enumerate(zip(queries[a : a + 64], query_ids[a : a + 64], score, limits, strict=True)):
            near = np.flatnonzero(own > limit)
            near = np.concatenate([near, np.flatnonzero((own == limit) & (ids != query_id))[: rerank - len(near)]])
            if not len(near):
                continue
            exact = exactly(q, near)
            if len(near) >= k:
                least = np.partition(exact, len(exact) - k)[len(exact) - k]
                open_ = (inner[i] >= least) & (product[i] >= least)
                near = np.flatnonzero(open_[same] & (ids != query_id))
                exact = exactly(q, near)
            best = np.lexsort((ids[near], -exact))[:k]
            yield int(query_id), ids[near][best], exact[best]


ENCODED = "id long, v array<{kind}>, q boolean, cell int, codes binary, norm float, error float, visits array<int>"


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, rerank: int = RERANK, books: int = BOOKS, words: int = WORDS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest other rows by cosine, ties to the smaller id.

    Vectors that are null or zero, hold a null or non-finite component, or are not of the table's most common length take no part; nor
    do rows with a null id.  Ids are whole numbers.  Rows with the query's own id are not its neighbours; a query id that is repeated is
    asked once, with the smallest of its vectors.  Repeated other rows each count.  Fewer candidates than k in the cells that a query
    visits: those.  An empty table gives no rows.
    Codebooks and centres are fitted on about SAMPLE rows, picked by a hash of the id; every row is encoded and lies in a cell.
    ``rerank`` rows of each part are scored exactly first; the k-th of them decides which others are checked.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "double" if "double" in vectors.schema[vector].dataType.simpleString() else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("queries")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = int(sizes["dim"]), int(sizes["n"])
    rows = rows.filter(F.size("v") == dim)
    share = min(1.0, SAMPLE / n, SAMPLE_NUMBERS / dim / n)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 32)) < share * (1 << 32)).select("v").toArrow()
    if not sample.num_rows:
        sample = rows.select("v").limit(1).toArrow()
    part = min(1.0, ASKED / sizes["queries"], SAMPLE_NUMBERS / dim / sizes["queries"])
    some = rows.filter("q").filter(F.pmod(F.xxhash64("id", F.lit("asked")), F.lit(1 << 32)) < part * (1 << 32)).select("v").toArrow()
    asked = unit(matrix(some.column(0), dim)) if some.num_rows else None
    learned = np.unique(unit(matrix(sample.column(0), dim)), axis=0)  # copies teach nothing
    shared = spark.sparkContext.broadcast((Codebooks.fit(learned, books, words), Cells.fit(learned, min(MOST_CELLS, round(math.sqrt(n) / 4)), k, asked)))

    def encoded(batches):
        begin("neighbours")
        codebooks, cells = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = unit(matrix(part.column(1), dim))
                codes, norms, errors = codebooks.encode(x)
                near = cells.nearest(x)
                visits = [v.tolist() if q else None for q, v in zip(part.column(2).to_pylist(), near[:, : cells.visited], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near[:, 0], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(errors, pa.float32()), pa.array(visits, pa.list_(pa.int32()))], names=["id", "v", "q", "cell", "codes", "norm", "error", "visits"])
        release()

    table = materialised(rows.mapInArrow(encoded, ENCODED.format(kind=kind)))
    asked = table.filter("q").groupBy("id").agg(F.min(F.struct("v", "visits")).alias("x")).select(F.col("id").alias("query"), F.col("x.v").alias("at"), F.explode("x.visits").alias("cell"))
    held = table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    visited = table.filter("q").select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    split = F.broadcast(held.join(visited, "cell"))  # a row for each cell, MOST_CELLS at most
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    key = ["cell", "part", "block"]
    data = table.join(split, "cell").select("cell", F.pmod(F.xxhash64("id", "v"), F.col("parts")).alias("part"), upto("blocks").alias("block"), "id", "v", "codes", "norm", "error")
    queries = asked.join(split, "cell").select("cell", upto("parts").alias("part"), F.pmod(F.xxhash64("query"), F.col("blocks")).alias("block"), "query", "at")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            for query, near, score in found_in_part(shared.value[0], matrix(right.column("at"), dim), right.column("query").to_numpy(), matrix(left.column("v"), dim), left.column("id").to_numpy(), codes, left.column("norm").to_numpy(), left.column("error").to_numpy(), k, rerank):
                out[0].append(np.full(len(near), query))
                out[1].append(near)
                out[2].append(score)
        release()
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = data.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(scored, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0)
