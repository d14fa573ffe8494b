"""Best-fit packing of tokenised documents into sequences of bounded length, by best-two-fit.

A sequence is filled greedily with the longest piece that fits its gap.  When nothing fits, its smallest piece is taken out again if
two pieces not yet packed fit the expanded gap more tightly.  Lengths are small whole numbers, so the unpacked pieces are kept as
stacks by length, with a bit mask of the lengths that are left; "longest that fits" and "two that sum to" are operations on that mask.
Sequences are made within groups of documents, each of a bounded number of pieces; a group ends with one sequence that isn't full.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, release, small_batches, text_bytes

#: Pieces of a packing group at most, about.
GROUP = 100_000
#: Words of a generation; two are remembered.
CACHE_WORDS = 250_000
#: Lower-case words of ASCII and Latin-1 letters, which normalisation leaves alone, and the parts that the vocabulary cuts them into.
PLAIN = re.compile(rb"(?:[!-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])+")
PARTS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-@\[-`{-~]+")
#: The vocabulary's characters for bytes that have no printable one of their own.
BYTE_CHARS = {b: 289 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 323}
PIECES = "{id} {type}, piece int, start long, length long, ids_crc32 long, ids binary"


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Word bytes -> little-endian uint32 ids.  The vocabulary drops white space and never joins across it, so a text's ids are those
    of its words.  A plain word's parts go straight to the vocabulary's model, which takes a quarter of the time; all other words go
    through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.cut = self.tokenizer.model.tokenize
        self.before: dict[bytes, bytes] = {}

    def part(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        if not word.isascii():
            text = text.translate(BYTE_CHARS)
        return pack_ids([token.id for token in self.cut(text)])

    def __missing__(self, word: bytes) -> bytes:
        if (value := self.before.get(word)) is not None:
            pass  # a word met again stays for another generation
        elif word.isalpha() and word.islower():
            value = self.part(word)
        elif word[-1] in b".," and word[:-1].isalpha() and word.islower():
            value = self[word[:-1]] + self[word[-1:]]
        elif PLAIN.fullmatch(word) and b"<|" not in word:
            parts = PARTS.findall(word)
            value = self.part(word) if len(parts) == 1 else b"".join(map(self.__getitem__, parts))
        else:
            value = pack_ids(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = value
        return value

    def ids(self, text: bytes) -> bytes:
        # upper case is only kept where a special token's own spelling may matter, or composition with U+0300 to U+036F, which comes
        # before lower case
        if b"<|" in text:
            words = text.split()
        elif b"\xcc" in text or b"\xcd" in text:
            words = [w.lower() if w.isascii() else w for w in text.split()]
        else:
            words = text.lower().split()
        return b"".join(map(self.__getitem__, words))


_TOKENIZERS: dict[str, WordIds] = {}


def tokenizer(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, id_col: str, text: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian uint32)."""
    kind = docs.schema[id_col].dataType
    schema = PIECES.format(id=f"`{id_col}`", type=kind.simpleString())
    end, step = np.uint32(end_id).tobytes(), 4 * capacity

    def cut(batches):
        begin("packing", _TOKENIZERS.clear)
        words = tokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                ids = words.ids(value.as_py() or b"") + end
                for i, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    rows.append((key.as_py(), i, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=[id_col, "piece", "start", "length", "ids_crc32", "ids"])
        release()

    return docs.select(id_col, text).mapInArrow(cut, schema)


class Stock:
    """Unpacked pieces by length, with a mask whose bit n says that some piece of length n is left."""

    def __init__(self, lengths: np.ndarray):
        self.by: dict[int, list[int]] = {}
        self.mask = 0
        for i in np.lexsort((np.arange(len(lengths))[::-1], lengths)):  # the first of equal ones is on top
            self.by.setdefault(int(lengths[i]), []).append(int(i))
        for n in self.by:
            self.mask |= 1 << n

    def take(self, n: int) -> int:
        own = self.by[n]
        i = own.pop()
        if not own:
            self.mask &= ~(1 << n)
        return i

    def put(self, n: int, i: int) -> None:
        self.by[n].append(i)
        self.mask |= 1 << n

    def longest(self, most: int) -> int:
        """Length of the longest piece of at most that length, 0 if none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def two(self, most: int, over: int) -> tuple[int, int] | None:
        """Two lengths with the largest sum of at most ``most`` and more than ``over``."""
        width = most + 1
        low = self.mask & ((1 << width) - 1)
        if not low:
            return None
        mirrored = int(format(low, f"0{width}b")[::-1], 2)  # bit most - n for length n
        for total in range(most, over, -1):
            both = low & (mirrored >> (most - total))
            while both:
                a = both.bit_length() - 1
                b = total - a
                if b < 1 or a < b:
                    break
                if a != b or len(self.by[a]) > 1:
                    return a, b
                both &= ~(1 << a)
        return None


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the pieces of each sequence."""
    if len(lengths) and not 1 <= int(lengths.min()) <= int(lengths.max()) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    stock, out = Stock(lengths), []
    while stock.mask:
        bin_, gap = [], capacity
        while gap and (n := stock.longest(gap)):
            bin_.append(stock.take(n))
            gap -= n
        if gap and stock.mask:
            least = min(bin_, key=lambda i: lengths[i])
            size = int(lengths[least])
            if pair := stock.two(gap + size, size):
                bin_.remove(least)
                bin_ += [stock.take(pair[0]), stock.take(pair[1])]
                stock.by.setdefault(size, [])
                stock.put(size, least)
        out.append(bin_)
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", with_ids: bool = True, group: int = GROUP) -> DataFrame:
    """Tokenises documents and packs them into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: id_col, piece, start, length, ids_crc32, ids (null unless with_ids), sequence_id, offset.
    Only a document longer than the capacity is cut, into whole sequences and a rest.  Null or empty text: its end id alone.  Rows with
    null or equal ids are documents of their own.  Other columns are ignored.  An empty table gives an empty result.  Pieces of equal
    length are taken in the order of id, piece and crc32; equal rows are alike, so it doesn't matter which is which.
    Groups have about ``group`` pieces at most: a token has a byte at least, so rows and bytes bound the number of pieces.
    """
    small_batches(docs.sparkSession)
    n, size = text_bytes(docs, text)
    groups = max(1, math.ceil((n + size / capacity) / group))
    rows = pieces(docs, path, id_col, text, capacity, end_id, with_ids)
    spread = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "piece", "ids_crc32", "length")
    rows = rows.withColumn("__grp", F.pmod(spread, F.lit(groups)))

    def packed(table: pa.Table) -> pa.Table:
        number = table.column("__grp")[0].as_py()
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, bin_ in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = (number << 32) + k, at
                at += int(lengths[i])
        return table.drop_columns(["__grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = PIECES.format(id=f"`{id_col}`", type=docs.schema[id_col].dataType.simpleString()) + ", sequence_id long, offset long"
    return rows.groupBy("__grp").applyInArrow(packed, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")
