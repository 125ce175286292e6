"""Byte-level BPE encoding and decoding.

Encoding runs each match of the pattern through a transducer compiled from the ranks and
determinised as texts need it (:class:`kinmesh.llm.bpe.Transducer`). Decoding joins token
bytes chunk by chunk through an incremental UTF-8 state machine. Both are per row: no
shuffle; the memo of pieces and the table of states are bounded.

Ids are packed as little-endian unsigned 32-bit integers, as training shards hold them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.bpe import Deferred, Memo, Transducer, Utf8Decoder, load_ranks, piece_finder, trim
from kinmesh.session import own_name, read_table

#: Ids decoded at a time, and rows of a batch held as Python values at a time.
CHUNK, SLICE = 4096, 256


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}

    def decode(self, packed: bytes) -> str:
        stream, out, token = Utf8Decoder(), [], self.bytes_of.__getitem__
        for at in range(0, len(packed), 4 * CHUNK):
            part = packed[at : at + 4 * CHUNK]
            out.append(stream.feed(b"".join(map(token, struct.unpack(f"<{len(part) // 4}I", part)))))
        out.append(stream.finish())
        return "".join(out)


class Packed(Memo):
    """The packed ids of a piece."""

    def __init__(self, transducer: Transducer, size: int):
        super().__init__(size)
        self.transducer = transducer

    def compute(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)


class Codec(Decoder):
    def __init__(self, ranks: dict[bytes, int], cache: int = 40_000):
        super().__init__(ranks)
        self.find = piece_finder()
        self.packed = Packed(Transducer(ranks), cache)

    def forget(self) -> None:
        """Drop the memo at the end of a task, as an executor keeps more workers than it runs tasks; the table of states, which is bounded and slow to fill, stays."""
        self.packed.forget()
        trim()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.find(text)))


def sliced(values: pa.Array, run) -> pa.Array:
    """``run`` over the Python values of slices of an Arrow array, so that few of them stand beside it at a time."""
    parts = [run(values.slice(at, SLICE).to_pylist()) for at in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else run([])


def codec_columns(spark: SparkSession, ranks: str) -> tuple:
    """(encode, decode, both) column functions for a ranks file.

    Null text encodes as empty, null ids decode to null. ``both`` is a struct of the ids and
    of the text decoded from them, for one trip to the workers.
    """
    with open(ranks, "rb") as f:
        held = load_ranks(f.read())
    sent = spark.sparkContext.broadcast(Deferred(Codec, held))
    plain = spark.sparkContext.broadcast(Deferred(Decoder, held))

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = sent.value
        for texts in batches:
            yield sliced(texts, lambda ts: pa.array([codec.encode(t) if t else b"" for t in ts], pa.binary()))
        codec.forget()

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        decoder = plain.value
        return sliced(ids, lambda xs: pa.array([None if x is None else decoder.decode(x) for x in xs], pa.string()))

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = sent.value

        def run(ts: list) -> pa.Array:
            ids = [codec.encode(t) if t else b"" for t in ts]
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], ["ids", "decoded"])

        for texts in batches:
            yield sliced(texts, run)
        codec.forget()

    return encode, decode, both


def n_ids(packed: Column) -> Column:
    return F.floor(F.octet_length(packed) / 4).cast("bigint")


def encode_documents(df: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (packed), ``n_tokens`` and ``decoded`` (the ids read back) for each whole text.

    A null text counts as empty. Existing columns of these names are replaced; an empty
    table stays empty. An id outside the ranks is an error, as it has no bytes.
    """
    _, _, both = codec_columns(df.sparkSession, ranks)
    name = own_name(df, "coded")
    coded = df.withColumn(name, both(F.col(text)))
    return coded.withColumns({"ids": F.col(name)["ids"], "n_tokens": n_ids(F.col(name)["ids"]), "decoded": F.col(name)["decoded"]}).drop(name)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
