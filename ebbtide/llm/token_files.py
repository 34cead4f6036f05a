"""Token ids as binary files of patched frame-of-reference blocks.

A file (all numbers little-endian): 8 bytes ``TOKENPFR``; counts of documents, ids and blocks (unsigned 64-bit);
doc_id of each document (signed 64-bit); one byte each, 1 where the doc_id is null; number of ids of each document
(unsigned 32-bit); first byte of each block, counted from the first block, and the end of the last (unsigned 64-bit);
blocks. A block holds 128 ids (the last is filled up): smallest id (unsigned 32-bit), bit width, number of exceptions
(a byte each), the low bits of id - smallest packed at that width, places of the exceptions (a byte each) and their
whole differences (unsigned 32-bit). The width is the one that nine in ten differences of the block fit in.
"""

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.text import held, row_hash, vocabulary, whole_text, word_encoder
from ebbtide.session import scratch_path

MAGIC = b"TOKENPFR"
BLOCK = 128
FITTING_SHARE = 0.9
#: Ids after which a file is closed, and bytes of text that are encoded together.
FILE_IDS = 4_000_000
END_ID = 1
_HEAD = 6
#: Blocks that are packed or unpacked together; the working arrays take about 50 times the bytes of their ids.
PART_BLOCKS = 2048


def _runs(starts, width):
    """Places of the ``width`` bytes from each start."""
    return starts[:, None] + np.arange(width)


def encode_blocks(ids: np.ndarray, share=FITTING_SHARE):
    """(bytes of all blocks, first byte of each and the end) for unsigned 32-bit ids."""
    packed, starts, size = [], [np.zeros(1, np.uint64)], 0
    for i in range(0, len(ids), PART_BLOCKS * BLOCK):
        data, own = _encode_part(ids[i : i + PART_BLOCKS * BLOCK], share)
        packed.append(data)
        starts.append(own[1:] + np.uint64(size))
        size += len(data)
    return b"".join(packed), np.concatenate(starts)


def _encode_part(ids, share):
    n_blocks = -(-len(ids) // BLOCK)
    filled = np.empty(n_blocks * BLOCK, np.int64)
    filled[: len(ids)] = ids
    filled[len(ids) :] = ids[-1]
    values = filled.reshape(n_blocks, BLOCK)
    smallest = values.min(axis=1)
    rest = values - smallest[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    fit = int(np.ceil(share * BLOCK)) - 1
    widths = np.partition(bits, fit, axis=1)[:, fit].astype(np.int64)
    is_exception = bits > widths[:, None]
    n_exceptions = is_exception.sum(axis=1)
    packed_size = widths * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(_HEAD + packed_size + 5 * n_exceptions)])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[_runs(at, 4)] = smallest.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4] = widths
    out[at + 5] = n_exceptions
    for width in np.unique(widths):
        if width:
            of_width = np.flatnonzero(widths == width)
            for i in range(0, len(of_width), 2048):
                rows = of_width[i : i + 2048]
                whole = rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4)
                bits_of = np.unpackbits(whole, axis=2, bitorder="little")[:, :, :width]
                packed = np.packbits(bits_of.reshape(len(rows), -1), axis=1, bitorder="little")
                out[_runs(at[rows] + _HEAD, packed.shape[1])] = packed
    block, place = np.nonzero(is_exception)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_exceptions) - n_exceptions, n_exceptions)
    first = (at + _HEAD + packed_size)[block]
    out[first + nth] = place
    whole = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[_runs(first + n_exceptions[block] + 4 * nth, 4)] = whole
    return out.tobytes(), starts.astype(np.uint64)


def decode_blocks(data, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """Ids of the blocks whose first bytes (and the end of the last) are given; any range of blocks can be read."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(n_ids, np.uint32)
    for i in range(0, len(starts) - 1, PART_BLOCKS):
        part = out[i * BLOCK : (i + PART_BLOCKS) * BLOCK]
        part[:] = _decode_part(raw, starts[i : i + PART_BLOCKS + 1])[: len(part)]
    return out


def _decode_part(raw, starts):
    at = starts[:-1].astype(np.int64)
    smallest = raw[_runs(at, 4)].copy().view("<u4")[:, 0].astype(np.int64)
    widths, n_exceptions = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    rest = np.zeros((len(at), BLOCK), np.int64)
    for width in np.unique(widths):
        if width:
            of_width = np.flatnonzero(widths == width)
            for i in range(0, len(of_width), 2048):
                rows = of_width[i : i + 2048]
                packed = raw[_runs(at[rows] + _HEAD, width * BLOCK // 8)]
                whole = np.zeros((len(rows), BLOCK, 32), np.uint8)
                whole[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
                rest[rows] = np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
    block = np.repeat(np.arange(len(at)), n_exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_exceptions) - n_exceptions, n_exceptions)
    first = (at + _HEAD + widths * (BLOCK // 8))[block]
    if len(block):
        whole = raw[_runs(first + n_exceptions[block] + 4 * nth, 4)].copy().view("<u4")[:, 0]
        rest[block, raw[first + nth]] = whole
    rest += smallest[:, None]
    return rest.reshape(-1)


def file_bytes(doc_ids, ids_of_documents) -> bytes:
    """One file: ``doc_ids`` (None for null) and the ids of each document."""
    lengths = np.array([len(x) for x in ids_of_documents], "<u4")
    ids = np.concatenate([np.empty(0, np.uint32), *ids_of_documents])
    blocks, starts = encode_blocks(ids)
    return b"".join(
        [
            MAGIC,
            struct.pack("<QQQ", len(lengths), len(ids), len(starts) - 1),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            lengths.tobytes(),
            starts.astype("<u8").tobytes(),
            blocks,
        ]
    )


def read_file(data: bytes):
    """(doc_ids, lengths, ids) of one file."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token blocks")
    n_docs, n_ids, n_blocks = struct.unpack_from("<QQQ", data, 8)
    at = 32
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    at += 9 * n_docs
    lengths = np.frombuffer(data, "<u4", n_docs, at)
    at += 4 * n_docs
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
    ids = decode_blocks(memoryview(data)[at + 8 * (n_blocks + 1) :], starts, n_ids)
    return [None if null else int(d) for d, null in zip(doc_ids, nulls)], lengths, ids


def _filesystem(folder):
    """File system and path of a folder that all executors share (file, hdfs, s3, gs ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder, name, data):
    """Write a file under a name of its own and move it into place, so that a repeated task leaves one whole file."""
    import uuid

    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{path}/{name}")


FILE_SCHEMA = pa.schema(
    [("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())]
)
FILES = "part int, number int, name string, n_documents long, n_ids long"


def write_token_files(docs: DataFrame, folder, path=None, end_id=END_ID, file_ids=FILE_IDS) -> DataFrame:
    """Encode every whole text and write the ids, end_id behind each document, in ascending doc_id order.

    Rows are dealt by ranges of doc_id (null last, ties by a hash of the text) and sorted; each task encodes its rows
    and writes files of about ``file_ids`` ids below ``folder``, which all executors must share. A null text is
    empty and has the end id only; repeated rows are written each. Returns the list of the files, a row for each,
    which is written below ``folder`` too. Other columns are not read; an empty table gives no files.
    """
    path = path or vocabulary("word_bpe_49k.json")
    end = np.array([end_id], np.uint32)

    def write(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        doc_ids, encoded, size = [], [], 0

        def close():
            name = f"part-{part:06d}-{number:05d}.tokens"
            _put(folder, name, file_bytes(doc_ids, encoded))
            row = (part, number, name, len(doc_ids), size)
            return pa.RecordBatch.from_pylist([dict(zip(FILE_SCHEMA.names, row))], FILE_SCHEMA)

        for batch in batches:
            of_rows = zip(batch["doc_id"].to_pylist(), batch["is_null"].to_pylist())
            for (doc_id, is_null), ids in zip(of_rows, word_encoder(path).encode_each(batch["text"])):
                doc_ids.append(None if is_null else doc_id)
                encoded.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= file_ids:
                    yield close()
                    number, size = number + 1, 0
                    doc_ids, encoded = [], []
        if doc_ids:
            yield close()

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNull().alias("is_null"),
        row_hash().alias("h"),
        whole_text().alias("text"),
    )
    order = ["is_null", "doc_id", "h"]
    written = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, FILES)
    written.write.mode("overwrite").parquet(f"{folder}/files")
    return docs.sparkSession.read.schema(T._parse_datatype_string(FILES)).parquet(f"{folder}/files")


def read_token_files(files: DataFrame, folder) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, read back and decoded.

    ``files`` is the list that ``write_token_files`` returned; start counts the ids of all documents before.
    """
    # One row for each file.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        held("token files", dict)  # the encoder that writing kept in this worker goes
        system, path = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch["name"], batch["first"]):
                with system.open_input_stream(f"{path}/{name}") as source:
                    doc_ids, lengths, ids = read_file(source.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                starts = ends - lengths
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(doc_ids, "Int64"),
                        "start": first + starts,
                        "n_tokens": lengths.astype(np.int64),
                        "ids_crc32": [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())],
                    }
                )

    n_tasks = max(1, files.count())
    return placed.repartition(n_tasks, "name").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, folder=None, **settings) -> DataFrame:
    """Write ``docs`` to token files (by default in the shared folder) and read the documents back from them."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **settings), folder)
