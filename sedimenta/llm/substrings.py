"""Substring deduplication by seeds and counted windows.

Every run of SIZE words holds, among the hashes of its SEED-word runs, a smallest one: its anchor (winnowing).  Equal windows have equal
anchors, so documents are joined on anchors first, and only windows whose anchor is found in two places or more are looked at again.
Nothing is extended pairwise: every window with a repeated anchor is hashed and counted, so each one is decided on its own; overlapping
repeated windows merge into maximal repeats of SIZE words or more, and their words are taken out.

Both joins are count exchanges (see ``common``): a group of documents sends each distinct anchor or window once, with its count, however
many copies there are, and learns which of them the whole corpus holds twice or more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import REQUEST, answers, aside, begin, flags, hashed_texts, in_groups, release, replies, request_rows, request_table, small_batches, spread, text_bytes, texts, windows

SIZE, SEED = 35, 12
KEYS_PER_BUCKET = 1_500_000


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each ``width`` values."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(hashes: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the anchors of all places that some window chose."""
    if len(hashes) < size:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    runs = windows(hashes, seed)
    width = size - seed + 1
    chosen = sliding(runs, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    largest = sliding(np.concatenate([edge, chosen, edge]), width, np.maximum)
    return chosen, runs[largest == runs]


def repeated_anchors(chosen: np.ndarray, known: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """For each window whether its anchor is repeated.  known: sorted anchors, twice: of each, whether it is."""
    if not len(chosen):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    found = twice[np.searchsorted(known, chosen[starts])]
    return np.repeat(found, np.diff(np.r_[starts, len(chosen)]))


def covered(n_words: int, repeated: np.ndarray, size: int) -> np.ndarray:
    """Words inside a repeated window; repeated: starts."""
    edges = np.zeros(n_words + 1, np.int32)
    np.add.at(edges, repeated, 1)
    np.add.at(edges, repeated + size, -1)
    return np.cumsum(edges[:-1]) > 0


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, seed: int = SEED) -> DataFrame:
    """docs with kept_text (the kept words joined by one space), n_words and n_removed.

    A word goes if it lies in a window of ``size`` words of its document whose words also start anywhere else, in any document.
    All windows are judged on the input, so that every copy of a passage goes.  Null, empty or blank text: no words, empty kept_text.
    Texts shorter than ``size`` words stay.  Null or repeated ids, and repeated rows, are documents of their own and repeat each other.
    Other columns pass through; those named like an added one are replaced.  An empty table gives an empty result.
    Windows are compared by 64-bit hashes of words and their places.
    """
    docs, restored = aside(docs.drop("kept_text", "n_words", "n_removed"), "__grp")
    small_batches(docs.sparkSession)
    total = text_bytes(docs, text)
    grouped, _ = in_groups(docs, id_col, text, total, 4 << 20)
    schema = StructType([*docs.schema.fields, StructField("kept_text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    words = total[1] / 6
    few, many = (max(1, math.ceil(words * share / KEYS_PER_BUCKET)) for share in (0.1, 0.4))

    def read(table: pa.Table) -> list[np.ndarray]:
        begin("substrings")
        return hashed_texts(list(texts(table.column(text))))

    def known_anchors(hashes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        found = [anchors(h, size, seed) for h in hashes]
        keys, counts = np.unique(spread(np.concatenate([p for _, p in found])), return_counts=True)
        return [spread(c) for c, _ in found], keys, counts

    def ask_anchors(table: pa.Table) -> pa.Table:
        _, keys, counts = known_anchors(read(table))
        release()
        return request_table(request_rows(table.column("__grp")[0].as_py(), keys, counts, few))

    def candidates(hashes: list[np.ndarray], right: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Starts and hashes of the windows of each text whose anchor is repeated."""
        chosen, keys, _ = known_anchors(hashes)
        twice = answers(right, 0, np.uint8).astype(bool)
        if len(twice) != len(keys):
            raise ValueError(f"{len(twice)} answers for {len(keys)} anchors")
        starts = [np.flatnonzero(repeated_anchors(c, keys, twice)) for c in chosen]
        return starts, [windows(h, size)[s] if len(s) else np.empty(0, np.uint64) for h, s in zip(hashes, starts, strict=True)]

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return request_table([])
        _, found = candidates(read(left), right)
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        release()
        return request_table(request_rows(left.column("__grp")[0].as_py(), keys, counts, many))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kept, n_words, n_removed = [], [], []
        if left.num_rows:
            values = list(texts(left.column(text)))
            starts, found = candidates(hashed_texts(values), right)
            keys, place = np.unique(np.concatenate(found), return_inverse=True)
            twice = answers(right, 1, np.uint8).astype(bool)
            if len(twice) != len(keys):
                raise ValueError(f"{len(twice)} answers for {len(keys)} windows")
            at = 0
            for value, start in zip(values, starts, strict=True):
                own = value.split()
                repeated = start[twice[place[at : at + len(start)]]]
                at += len(start)
                gone = covered(len(own), repeated, size) if len(repeated) else None
                stay = own if gone is None else [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(stay))
                n_words.append(len(own))
                n_removed.append(len(own) - len(stay))
        left = left.drop_columns(["__grp"])
        release()
        return left.append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string())).append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))

    # the same exchange of documents serves all three passes
    first = replies(grouped.groupBy("__grp").applyInArrow(ask_anchors, REQUEST), flags, 0)
    asked = grouped.groupBy("__grp").cogroup(first.groupBy("__grp")).applyInArrow(ask_windows, REQUEST)
    both = first.unionByName(replies(asked, flags, 1))
    return restored(grouped.groupBy("__grp").cogroup(both.groupBy("__grp")).applyInArrow(finish, schema))


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
