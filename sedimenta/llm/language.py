"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of orders 0 to 3 is counted on labelled documents and then frozen.  A byte that a context has
seen c times costs -log2(c / (T + q)) bits, where T is the context's total and q its number of distinct bytes; else the escape,
-log2(q / (T + q)) bits, and then what the next shorter context asks; below order 0 a byte costs 8 bits.  A context that was never
seen is skipped without cost.  The language whose tree gives the shortest code for the whole text wins.

Every byte's cost depends on the last four bytes alone, so costs are worked out once for each four-byte string that occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import begin, release, small_batches

ORDER = 3
START = b"\0" * ORDER
#: Labelled text to learn from: bytes for each language, about (a hash of the id picks the documents), and for all languages together.
SAMPLE_BYTES, ALL_BYTES = 1_500_000, 96_000_000
BLOCK = 1 << 19
PAIRS = 4096
#: Strings of four bytes whose costs a worker remembers at most; a full memory is emptied.
MEMORY = 1 << 20
UNKNOWN = "und"
SCALE = float(1 << 32)


def prepared(text: bytes) -> bytes:
    return START + text.lower()


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The strings of ``size`` bytes that end at each byte after the start."""
    out = np.zeros(len(data) - ORDER, np.uint32)
    for i in range(size):
        shift = size - 1 - i
        out |= data[ORDER - shift : len(data) - shift].astype(np.uint32) << np.uint32(8 * shift)
    return out


def count_grams(batches):
    """lang, size, gram, n: what a task has seen."""
    seen: dict[tuple[str, int], list] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            data = np.frombuffer(prepared(text.as_py()), np.uint8)
            for size in range(1, ORDER + 2):
                own = seen.setdefault((lang, size), [])
                own.append(np.unique(grams(data, size), return_counts=True))
                if len(own) > 200:
                    seen[lang, size] = [summed(own)]
    for (lang, size), own in seen.items():
        g, n = summed(own)
        yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array([size] * len(g), pa.int32()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "size", "gram", "n"])


def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    g, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(place, np.concatenate([p[1] for p in parts]), len(g))


class Trees:
    """The frozen trees of all languages, as sorted arrays of strings and contexts for each order."""

    def __init__(self, counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted({lang for lang, _ in counts})
        self.levels = [[self.level(*counts[lang, size]) for size in range(1, ORDER + 2)] for lang in self.languages]
        self.forget()

    @staticmethod
    def level(g: np.ndarray, n: np.ndarray) -> tuple:
        g, n = g.astype(np.uint32), n.astype(np.float64)
        order = np.argsort(g)
        g, n = g[order], n[order]
        contexts, place, q = np.unique(g >> np.uint32(8), return_inverse=True, return_counts=True)
        total = np.bincount(place, n)
        return g, np.log2((total + q)[place] / n), contexts, np.log2((total + q) / q)

    def __getstate__(self):
        return {"languages": self.languages, "levels": self.levels}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.forget()

    def forget(self) -> None:
        self.pair_ids = np.zeros(1 << 16, np.uint16)
        self.pairs = 1
        self.index = None
        self.costs = np.zeros((1, len(self.languages)))
        self.used = 1

    def exact(self, g: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte string, for each language."""
        return np.stack([self.bits(levels, g) for levels in self.levels], 1)

    def bits(self, levels: list[tuple], g: np.ndarray) -> np.ndarray:
        def found(among: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(among, x), len(among) - 1)
            return among[at] == x, at

        cost = np.full(len(g), 8.0)
        for size, (known, own, contexts, escape) in enumerate(levels, 1):
            x = g & np.uint32((1 << 8 * size) - 1)
            has, at = found(known, x)
            seen, where = found(contexts, x >> np.uint32(8))
            cost = np.where(has, own[at], cost + np.where(seen, escape[where], 0))
        return cost

    def all_bits(self, data: np.ndarray) -> np.ndarray:
        """Costs of each byte after the start, for each language."""
        if self.index is None or self.used > MEMORY:
            self.forget()
            self.index = np.zeros(PAIRS * PAIRS, np.int32)
        pairs = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
        for p in np.flatnonzero(np.bincount(pairs[self.pair_ids[pairs] == 0], minlength=1 << 16)):
            if self.pairs < PAIRS:
                self.pair_ids[p] = self.pairs
                self.pairs += 1
        ids = self.pair_ids[pairs].astype(np.int32)
        first, second = ids[: len(data) - ORDER], ids[2 : len(data) - ORDER + 2]
        code = first * PAIRS + second
        place = self.index[code]
        odd = (first == 0) | (second == 0)
        if (new := (place == 0) & ~odd).any():
            g = grams(data, 4)
            codes, at = np.unique(code[new], return_index=True)
            fresh = self.exact(g[np.flatnonzero(new)[at]])
            if self.used + len(codes) > len(self.costs):
                self.costs = np.concatenate([self.costs, np.zeros((max(len(codes), len(self.costs)), self.costs.shape[1]))])
            self.costs[self.used : self.used + len(codes)] = fresh
            self.index[codes] = np.arange(self.used, self.used + len(codes), dtype=np.int32)
            self.used += len(codes)
            place = self.index[code]
        out = self.costs[place]
        if odd.any():
            out[odd] = self.exact(grams(data, 4)[odd])
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text for each language; short texts are taken together, long ones in blocks."""
        total = np.zeros((len(texts), len(self.languages)))
        waiting, size = [], 0
        for i, text in enumerate(texts):
            data = prepared(text)
            for a in range(0, max(1, len(text)), BLOCK):
                part = data[a : a + BLOCK + ORDER]
                waiting.append((i, part))
                size += len(part)
                if size >= BLOCK:
                    self.add(total, waiting)
                    waiting, size = [], 0
        self.add(total, waiting)
        return total

    def add(self, total: np.ndarray, parts: list[tuple[int, bytes]]) -> None:
        parts = [(i, p) for i, p in parts if len(p) > ORDER]
        if not parts:
            return
        bits = self.all_bits(np.frombuffer(b"".join(p for _, p in parts), np.uint8))
        # a part's own bytes follow its first ORDER; the next part's start is passed over
        starts = np.cumsum([0] + [len(p) for _, p in parts])
        sums = np.add.reduceat(bits, np.ravel([(s, s + len(p) - ORDER) for s, (_, p) in zip(starts, parts, strict=False)])[:-1], axis=0)[::2]
        np.add.at(total, [i for i, _ in parts], sums)


def train(docs: DataFrame, learn: Column, id_col: str, text: str, lang: str, sample_bytes: int) -> Trees | None:
    """Trees from a bounded sample of the labelled rows where ``learn`` holds; None without any.  Only a number for each language, the
    trees of that sample, comes to the driver."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text).cast("string")), F.lit("sample"))
    labelled = docs.filter(learn & F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(key, F.lit(1 << 32)).alias("h"))
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("h").alias("first")).collect()
    if not sizes:
        return None
    most = min(sample_bytes, ALL_BYTES // len(sizes))
    # the document with the smallest hash always counts, so no language is without one
    limits = {r["lang"]: max(r["first"] + 1, int(min(1.0, most / r["bytes"]) * SCALE)) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]
    picked = labelled.filter(F.col("h") < limit).select("lang", "text")
    rows = picked.mapInArrow(count_grams, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {key: (own["gram"].to_numpy(), own["n"].to_numpy()) for key, own in rows.groupby(["lang", "size"])}
    return Trees(counts) if counts else None


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """docs with lang_pred and score.

    learn: which rows may be learned from, if they have a language and a text; of each language about ``sample_bytes`` bytes of whole
    documents are used, one document at least (less of each, if there are so many languages that they would be over ALL_BYTES).  lang_pred: the language with the shortest code, the first by name among equals; ``und`` for a null text, a
    text without a letter, or if nothing could be learned.  score: the language's share of 2**-length over all languages, 0 for
    ``und``.  Whole texts are scored.  Null ids are fine; repeated rows get equal results; other columns pass through and those named
    lang_pred or score are replaced; an empty table gives an empty result.
    """
    docs = docs.drop(*(c for c in ("lang_pred", "score") if c in docs.columns))
    small_batches(docs.sparkSession)
    trees = train(docs, learn, id_col, text, lang, sample_bytes)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    if trees is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        import regex

        begin("language")
        letter = regex.compile(r"\p{L}")
        trees = shared.value
        for batch in batches:
            step = 500
            for a in range(0, max(1, batch.num_rows), step):
                rows = batch.slice(a, step)
                column = rows.column(rows.schema.get_field_index(text))
                values = column.to_pylist()
                known = [v is not None and letter.search(v) is not None for v in values]
                bits = trees.code_lengths([v.encode() if k else b"" for v, k in zip(values, known, strict=True)])
                best = bits.argmin(1) if len(values) else np.zeros(0, int)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1) if len(values) else np.zeros(0)
                pred = [trees.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, share, 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*rows.schema.names, "lang_pred", "score"])
        trees.forget()
        release()

    return docs.mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold() == 0, F.lit(False))
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
