"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the longest prefixes that the model's compiled character map knows; for each normalised byte the place of its
source is recorded.  The library's model then cuts the normalised text, with its own normalisation switched off, so that the ids are
those of this normalisation.  The pieces cover the normalised bytes one after the other, which is held against those bytes, and so
project to spans of the original text's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import begin, release, small_batches

SPACE = "▁".encode()
#: Bytes of text of a result batch, about.
BATCH = 4 << 20


class CharacterMap:
    """A model's normaliser: its compiled map is a double-array trie of byte strings, then the replacements, each closed by a zero."""

    def __init__(self, spec):
        blob = bytes(spec.precompiled_charsmap)
        self.units, self.replacements = [], b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.replacements = blob[4 + size :]
        self.dummy_prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else b" "

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key that starts here, and the place of its replacement; length 0: none."""
        units, best = self.units, (0, 0)
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node ^= step(unit)
            if unit & 0x100:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text after the map alone, and the source of each of its bytes."""
        if not self.units:
            return text, np.arange(len(text), dtype=np.int64)
        out, source, i = bytearray(), [], 0
        while i < len(text):
            n, place = self.longest(text, i)
            if n:
                new = self.replacements[place : self.replacements.index(0, place)]
            else:
                lead = text[i]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = text[i : i + n]
            out += new
            source += [i] * len(new) if new != text[i : i + n] else range(i, i + n)
            i += n
        return bytes(out), np.array(source, np.int64)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source of each of its bytes, closed by the end of the text."""
        n = len(text)
        mapped, source = self.mapped(text)
        b = np.frombuffer(mapped, np.uint8)
        blank = b == 32
        if self.squeeze and len(b):
            keep = ~blank | np.r_[False, ~blank[:-1]]
            last = np.flatnonzero(~blank)
            keep[last[-1] + 1 if len(last) else 0 :] = False
            b, source, blank = b[keep], source[keep], blank[keep]
        if not len(b):
            return b"", np.array([n], np.int64)
        wide = len(self.space)
        source = np.repeat(source, np.where(blank, wide, 1)) if wide > 1 else source
        out = b.tobytes().replace(b" ", self.space)
        if self.dummy_prefix:
            source, out = np.r_[np.full(wide, source[0]), source], self.space + out
        return out, np.r_[source, n]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = f.read()
        #: The model as it is, for decoding.
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.map = CharacterMap(proto.normalizer_spec)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        surface = lambda p: bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.encode()
        self.bytes = [surface(p) for p in proto.pieces]
        self.sizes = np.array([-1 if p.type == kinds.UNKNOWN else len(x) for p, x in zip(proto.pieces, self.bytes, strict=True)], np.int64)
        spec = proto.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        #: The same pieces, for texts that are normalised already.
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids (with begin and end, without sampling), begin and end in the original bytes of each (empty for begin and end ids), and
        the ids as a list."""
        normal, source = self.map.normalise(text)
        ids = self.cutter.encode(normal.decode(), add_bos=True, add_eos=True)
        array = np.array(ids, "<u4")
        sizes = self.sizes[array]
        if (sizes < 0).any():  # an unknown piece is its own text
            held = [p.piece.encode() if n < 0 else self.bytes[i] for p, n, i in zip(self.cutter.encode(normal.decode(), out_type="immutable_proto", add_bos=True, add_eos=True).pieces, sizes, ids, strict=True)]
            sizes = np.array([len(x) for x in held], np.int64)
        else:
            held = map(self.bytes.__getitem__, ids)
        if b"".join(held) != normal:
            raise ValueError("the pieces are not the normalised text")
        ends = np.cumsum(sizes)
        return array, np.stack([source[ends - sizes], source[ends]], 1), ids


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (binary, little-endian uint32), spans (binary, little-endian uint32 begin and end of each id in the text's
    UTF-8 bytes) and decoded (string).

    Ids are exactly those of the library, with begin and end ids; a text whose pieces aren't its normalised bytes fails.  Null text: as an empty one, begin and end alone.  Other columns pass
    through; those named ids, spans or decoded are replaced.  Each row is on its own, so repeated rows and empty tables need no care;
    a text of any length is encoded whole.
    """
    docs = docs.drop(*(c for c in ("ids", "spans", "decoded") if c in docs.columns))
    small_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("ids", BinaryType()), StructField("spans", BinaryType()), StructField("decoded", StringType())])

    def run(batches):
        begin("pieces", _MODELS.clear)
        pieces = model(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            first, size, out = 0, 0, ([], [], [])
            for i, value in enumerate(column):
                raw = value.as_py() or b""
                array, spans, ids = pieces.encode(raw)
                for to, x in zip(out, (array.tobytes(), spans.astype("<u4").tobytes(), pieces.processor.decode(ids)), strict=True):
                    to.append(x)
                size += len(raw) + 100
                if size >= BATCH:
                    yield joined(batch.slice(first, i + 1 - first), out)
                    first, size, out = i + 1, 0, ([], [], [])
            yield joined(batch.slice(first), out)
        release()

    def joined(rows: pa.RecordBatch, out: tuple[list, list, list]) -> pa.RecordBatch:
        added = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())]
        return pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, "ids", "spans", "decoded"])

    return docs.mapInArrow(run, schema)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))
