"""Token ids in compressed binary segments.

Layout of a segment (little-endian; one row of the output table, written and committed by Spark, so that a lost task
leaves no half file):

    magic "FTS2", u32 crc32 of the rest of the head, u32 n_docs, u32 n_blocks, u32 length of the zstandard frame,
    u32 bytes of each block ..., the frame: doc_id i64[n_docs], n_tokens i64[n_docs], u8[n_docs] 1 where the doc_id is null,
    the blocks.

A block holds up to 2**20 ids, whatever documents they belong to, and is coded by id_coder.py: context mixing of order-2 to order-0 predictions that adapt within the block, its own range coders and
its own checksum. It is reset at its start and is decoded by itself, without the head or its neighbours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, one_thread, shuffle_partitions
from .id_coder import MOST_IDS, decode_block, encode_block
from .tokens import column_encoder

MAGIC = b"FTS2"
#: Ids of a segment, documents kept whole.
SEGMENT_IDS = 4 * MOST_IDS
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 24_000_000
_HEAD = struct.Struct("<3I")


def encode_segment(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, nulls: np.ndarray | None = None, block: int = MOST_IDS) -> bytes:
    """Bytes of one segment. ids: u32, of all its documents in order; nulls: where the doc_id is null."""
    blocks = [encode_block(ids[k : k + block]) for k in range(0, len(ids), block)]
    nulls = np.zeros(len(doc_ids), np.uint8) if nulls is None else nulls.astype(np.uint8)
    frame = zstandard.ZstdCompressor(level=3).compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + nulls.tobytes())
    head = _HEAD.pack(len(doc_ids), len(blocks), len(frame)) + np.array([len(b) for b in blocks], dtype="<u4").tobytes() + frame
    return b"".join([MAGIC, struct.pack("<I", zlib.crc32(head)), head, *blocks])


def blocks_of(data: bytes) -> tuple[list[memoryview], np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a segment as they are, doc_ids, lengths, nulls. Raises ValueError where the head's checksum doesn't hold."""
    if data[:4] != MAGIC or len(data) < 8 + _HEAD.size:
        raise ValueError("not a segment")
    n_docs, n_blocks, n_frame = _HEAD.unpack_from(data, 8)
    at = 8 + _HEAD.size
    end = at + 4 * n_blocks + n_frame
    view = memoryview(data)
    if zlib.crc32(view[8:end]) != struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("damaged segment")
    sizes = np.frombuffer(data, "<u4", n_blocks, at).astype(np.int64)
    frame = zstandard.ZstdDecompressor().decompress(view[end - n_frame : end])
    ends = end + np.cumsum(sizes)
    blocks = [view[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist())]
    return blocks, np.frombuffer(frame, "<i8", n_docs), np.frombuffer(frame, "<i8", n_docs, 8 * n_docs), np.frombuffer(frame, np.uint8, n_docs, 16 * n_docs).astype(bool)


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids u32, doc_ids, lengths, nulls. Raises ValueError where a checksum doesn't hold."""
    blocks, doc_ids, lengths, nulls = blocks_of(data)
    ids = [decode_block(b) for b in blocks]
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32), doc_ids, lengths, nulls


SEGMENTS = "file_no int, segment_no int, first long, n_ids long, n_docs long, payload binary"
_SEGMENTS = pa.schema([("file_no", pa.int32()), ("segment_no", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])
FOUND = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_ids, texts) in slices of about SLICE_BYTES."""
    names, texts = batch.column(0), batch.column(1)
    step = max(1, int(len(texts) * SLICE_BYTES / max(1, texts.nbytes)))
    for k in range(0, len(texts), step):
        yield names.slice(k, step), texts.slice(k, step)


def _by_ranges(docs: DataFrame, n: int) -> DataFrame:
    """docs dealt to n partitions by ascending ranges of doc_id, null first. The bounds come from a pass over the doc_ids alone; a pass that samples rows would read the texts, too."""
    parts = [k / n for k in range(1, n)]
    held = docs.where("doc_id is not null")
    row = docs.agg(F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("named")).first()
    bounds = held.agg(F.percentile_approx("doc_id", parts, max(10_000, 20 * n))).first()[0] if parts and row["named"] else []
    if len(set(bounds)) < len(bounds) and row["all"] > 100 * n or row["all"] - row["named"] > row["all"] // n + 100:
        return docs.repartitionByRange(n, "doc_id", F.xxhash64("text"))
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda a: F.size(F.filter(a, lambda b: b < F.col("doc_id")))
    whole = F.lit(bounds).cast("array<long>") if bounds else F.array().cast("array<long>")
    coarse = below(F.lit(bounds[step - 1 :: step]).cast("array<long>")) if bounds else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(coarse * step + below(F.slice(whole, coarse * step + 1, step)))
    return docs.repartitionById(n, at.cast("int"))


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of all documents (doc_id, text), in ascending doc_id order over file_no, segment_no: null doc_ids first, equal ones in the order
    of their texts' xxhash64, then of their texts. A null text has only the end id. The rows are dealt by ranges of doc_id, as many as
    there are shuffle partitions, or of (doc_id, hash) where one doc_id fills a range, so that its texts are split; a task holds one segment at a time, which is as large as the largest document if that has more than segment_ids ids."""
    n = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = _by_ranges(docs, n).withColumn("h", F.xxhash64("text")).sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        enc = column_encoder(tokenizer_path)
        file_no = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        size = number = first = 0

        def flush() -> pa.RecordBatch:
            ids, n = np.concatenate(held), np.concatenate(lengths)
            data = encode_segment(ids, np.concatenate(names), n, np.concatenate(nulls))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((file_no, number, first, len(ids), len(n), data), _SEGMENTS)], schema=_SEGMENTS)

        for batch in batches:
            for doc_ids, texts in _slices(batch):
                ids, n = enc.encode(texts, end_id)
                held.append(ids)
                names.append(doc_ids.fill_null(0).to_numpy())
                lengths.append(n)
                nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
                size += len(ids)
                if size >= segment_ids:
                    yield flush()
                    held, names, lengths, nulls = [], [], [], []
                    first, size, number = first + size, 0, number + 1
        if held:
            yield flush()

    return dealt.mapInArrow(run, SEGMENTS)


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document, from the segments: doc_id, start, n_tokens, ids_crc32. Only the sums of the files, one number for each
    range, come to the driver."""
    sums = segments.groupBy("file_no").agg(F.sum("n_ids").alias("n")).orderBy("file_no").collect()
    starts, total = {}, 0
    for r in sums:
        starts[r["file_no"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for row in range(batch.num_rows):
                f, first, payload = (batch.column(k)[row] for k in range(3))
                ids, doc_ids, lengths, nulls = decode_segment(payload.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(doc_ids, mask=nulls), pa.array(begins + (starts[f.as_py()] + first.as_py())), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("file_no", "first", "payload").mapInArrow(run, FOUND)


def op5_token_ids(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes all documents' ids as segments to the shared folder, reads them back and returns a row per document.

    Nulls: a null text has the end id alone; null doc_ids come before all others and stay null. Repeated rows give repeated rows. Empty table: no rows.
    Further columns are ignored. The vocabulary is one that lower-cases and drops white space.
    """
    stage = Stage(spark, "token-ids")
    return read_segments(stage.write(write_segments(docs, tokenizer_path, end_id), "segments"))
