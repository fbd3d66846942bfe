"""Token ids in fixed-width bit packing: the writer, the reader and random access (operator 5).

A corpus is a Parquet table with one row per segment, in ascending order of (shard, segment):

    shard int          the range of ids that one task wrote; shards follow each other in id order
    segment int        place in the shard, from 0
    ids_before bigint  ids of the shard's earlier segments
    n_ids bigint       ids in this segment
    doc_ids array      the segment's documents in ascending order, null first
    doc_ends array     ids of the segment up to the end of each document
    payload binary     the packed ids

The payload is `FORMAT` (magic, version, bits, ids a block, blocks, ids), then one unsigned 64-bit
offset a block, then the blocks, each padded to whole bytes. All numbers are little-endian; id k of a
block takes bits k * bits to (k + 1) * bits - 1, the lowest bit first.
"""

from __future__ import annotations

import ctypes
import gc
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mapped, shared_dir

#: Fixed values of this format.
FORMAT, MAGIC, VERSION = struct.Struct("<4sHHIIQ"), b"FFID", 1
#: Ids a block, and ids after which a segment is closed at the end of a document.
BLOCK, SEGMENT = 4096, 1 << 20
#: Words that a worker keeps the ids of; beyond that they are encoded anew each time.
KEPT = 800_000


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary of this size takes."""
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    places = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return (places.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One payload. Ids that don't fit the width are an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} takes more than {bits} bits")
    blocks = [pack_block(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    head = FORMAT.pack(MAGIC, VERSION, bits, block, len(blocks), len(ids))
    first = len(head) + 8 * len(blocks)
    offsets = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[: len(blocks)].astype(np.uint64)
    return b"".join([head, offsets.astype("<u8").tobytes(), *blocks])


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a payload; reads only the blocks that hold them."""
    view = memoryview(payload)
    magic, version, bits, block, blocks, n = FORMAT.unpack_from(view)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a packed segment")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    offsets = np.append(np.frombuffer(view, "<u8", blocks, FORMAT.size), len(view)).astype(np.int64)
    a, b = start // block, (stop - 1) // block
    parts = [unpack_block(view[offsets[k] : offsets[k + 1]], min(block, n - k * block), bits) for k in range(a, b + 1)]
    return np.concatenate(parts)[start - a * block : stop - a * block]


class _Encoder(dict):
    """Packed little-endian 32-bit ids by word, through the tokenizers library.

    The file's rules never join characters across white space and drop it, so the words between ASCII
    white space are encoded apart. ASCII words are lower-cased and cut first, as the file does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.pieces: dict[bytes, bytes] = {}
        #: Fixed value: the pieces of the file's pre-tokenizer, over lower-case ASCII.
        self.cut = regex.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]

    def encoded(self, text: bytes) -> bytes:
        ids = self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def piece(self, piece: bytes) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            out = self.encoded(piece)
            if len(self.pieces) < KEPT:
                self.pieces[piece] = out
        return out

    def __missing__(self, word: bytes) -> bytes:
        if word.isascii() and not any(s in word for s in self.special) and not any(x < 0x20 for x in word):
            out = b"".join(map(self.piece, self.cut.findall(word.lower())))
        else:
            core = word.rstrip(b".,")  # a full stop or comma after a letter is a piece of its own
            tail = word[len(core) :]
            last = unicodedata.normalize("NFC", core.decode("utf-8")).lower()[-1:]
            if tail and last.isalpha() and not any(s in word for s in self.special):
                out = self.piece(core) + self.piece(tail)
            else:
                out = self.encoded(word)
        if len(self) < KEPT:
            self[word] = out
        return out

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def trimmed() -> None:
    """Gives back to the system what earlier tasks of this worker have freed: a reused worker keeps it otherwise."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ranges(spark: SparkSession) -> int:
    """Shards of a corpus: as many as the session deals shuffled data to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_packed(
    docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> None:
    """Encodes every whole text, appends end_id to each document and writes the corpus to path.

    Documents go in ascending id, null ids first; rows with the same id are ordered by text, so that
    reruns write the same ids. A null or empty text gives the end id alone. Shards are id ranges of
    about equal row counts; a task holds one segment of ids at a time, and one document at least.
    """
    bits = width(max(vocabulary_size(tokenizer), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind = pa.list_(to_arrow_type(docs.schema[id_col].dataType))
    frame = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    dealt = frame.repartitionByRange(shards or ranges(docs.sparkSession), "_id").sortWithinPartitions("_id", "_text")
    names = ["shard", "segment", "ids_before", "n_ids", "doc_ids", "doc_ends", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        encode, shard = encoder(tokenizer).ids, TaskContext.get().partitionId()
        segment = before = n = 0
        ids: list[bytes] = []
        who: list = []
        ends: list[int] = []

        def row() -> pa.RecordBatch:
            values = [shard], [segment], [before], [n], pa.array([who], arrow_kind), pa.array([ends], pa.list_(pa.int64()))
            payload = pa.array([pack(np.frombuffer(b"".join(ids), "<u4"), bits)], pa.binary())
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(values, kinds)), *values[4:], payload], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                data = encode(text.as_py() or b"")
                ids += [data, end]
                n += len(data) // 4 + 1
                who.append(doc)
                ends.append(n)
                if n >= SEGMENT:
                    yield row()
                    segment, before, n, ids, who, ends = segment + 1, before + n, 0, [], [], []
        if who:
            yield row()

    out = mapped(dealt, run, f"shard int, segment int, ids_before bigint, n_ids bigint, doc_ids array<{kind}>, doc_ends array<bigint>, payload binary"
    )
    out.write.parquet(path)


def read_packed(spark: SparkSession, path: str, per_document: Callable[[np.ndarray], int], *, id_col: str = "doc_id", value: str = "value") -> DataFrame:
    """Reads a corpus back: (id, start, n_tokens, value) per document, value from its ids as numpy uint32.

    start counts the ids of all documents before it: those of earlier shards, of earlier segments and
    of earlier documents. Only the shards' sums meet in one place: one small row a shard.
    """
    corpus = spark.read.parquet(path)
    kind = corpus.schema["doc_ids"].dataType.elementType.simpleString()
    sums = corpus.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    frame = corpus.join(F.broadcast(earlier), "shard").select(
        (F.col("shard_start") + F.col("ids_before")).alias("start"), "doc_ids", "doc_ends", "payload"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, start = unpack(batch.column(3)[i].as_py()), batch.column(0)[i].as_py()
                ends = np.array(batch.column(2)[i].as_py(), np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                values = [per_document(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i].values, pa.array(begins + start), pa.array(ends - begins), pa.array(values, pa.int64())],
                    [id_col, "start", "n_tokens", value],
                )

    return mapped(frame, run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, `{value}` bigint")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def packed_digest(docs: DataFrame, tokenizer: str, *, end_id: int = 1) -> DataFrame:
    """Writes docs as a corpus in the shared folder, reads it back: doc_id, start, n_tokens, ids_crc32.

    An empty table writes an empty corpus and gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    write_packed(docs, tokenizer, path, end_id=end_id)
    return read_packed(spark, path, crc32, value="ids_crc32")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
