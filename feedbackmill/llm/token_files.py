"""Token ids in binary files: frequency-ranked ids in a byte-aligned code with separate control bytes.

A file is a row of blocks, each readable on its own: a header, the ids of the block from the most
to the least frequent, the documents, the control bytes and the data bytes. An id is written as its
rank, in one to four bytes; a control byte holds the lengths less one of four ranks, two bits each.
Decoding looks a control byte up in a table of four lengths and gathers the data bytes with numpy.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedbackmill.llm.common import slices
from feedbackmill.llm.word_tokens import word_tokens
from feedbackmill.session import shared_dir, stage

MAGIC = b"FRVB"
#: Ids after which a block ends, and bytes after which a file does.
BLOCK_IDS = 1 << 21
FILE_BYTES = 32 << 20
_HEADER = "<4sIIIII"  # magic, ranks, documents, ids, data bytes, crc32 of what follows

#: The four lengths that a control byte holds.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One block of whole documents; an empty list gives a block without documents."""
    sizes = np.array([len(x) for x in ids], np.uint32)
    flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    counts = np.bincount(flat)
    by_rank = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.uint32)
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = rank_of[flat]
    lengths = (1 + (ranks >> 8 > 0) + (ranks >> 16 > 0) + (ranks >> 24 > 0)).astype(np.uint8)
    padded = np.ones(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths
    control = ((padded.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    data = np.zeros(int(lengths.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        long = np.flatnonzero(lengths > k)
        if len(long):
            data[starts[long] + k] = ranks[long] >> (8 * k)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    body = b"".join(
        a.tobytes() for a in (by_rank.astype("<u4"), names, nulls, sizes.astype("<u4"), control, data)
    )
    return struct.pack(_HEADER, MAGIC, len(by_rank), len(ids), len(flat), len(data), zlib.crc32(body)) + body


def decode_blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, whether null, sizes, all ids) of each block of a file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, ranks, docs, n, data_bytes, crc = struct.unpack_from(_HEADER, view, at)
        at += struct.calcsize(_HEADER)
        ends = np.cumsum([4 * ranks, 8 * docs, docs, 4 * docs, -(-n // 4), data_bytes]) + at
        if magic != MAGIC or ends[-1] > len(content) or zlib.crc32(view[at : ends[-1]]) != crc:
            raise ValueError("damaged block of token ids")
        parts = [view[a:b] for a, b in zip([at, *ends[:-1]], ends, strict=True)]
        by_rank = np.frombuffer(parts[0], "<u4")
        lengths = LENGTHS[np.frombuffer(parts[4], np.uint8)].reshape(-1)[:n]
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        data = np.frombuffer(parts[5], np.uint8)
        found = data[starts].astype(np.uint32)
        for k in range(1, 4):
            long = np.flatnonzero(lengths > k)
            if len(long):
                found[long] |= data[starts[long] + k].astype(np.uint32) << np.uint32(8 * k)
        yield (
            np.frombuffer(parts[1], "<i8"), np.frombuffer(parts[2], np.uint8) > 0,
            np.frombuffer(parts[3], "<u4"), by_rank[found] if n else found,
        )
        at = int(ends[-1])


def _put(folder: str, name: str, content: bytes) -> None:
    """Write a whole file under another name first, so that no reader and no second attempt meets half of it."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    files.create_dir(root, recursive=True)
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(content)
    files.move(draft, f"{root}/{name}")


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts and write them in ascending order of the id; returns the files as a table.

    Null and empty texts give the end id alone; null ids come first; rows of one id are all kept,
    by text. Other columns are ignored. An empty table gives no file. Files are named in the order
    of their documents, and a task that runs again writes the same ones again.
    """
    if end_id >= 1 << 32 or end_id < 0:
        raise ValueError("ids are unsigned 32-bit numbers")

    def write(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tokens, end = word_tokens(tokenizer), np.array([end_id], np.uint32)
        names, ids, held, file = [], [], 0, []

        def flush(blocks, number):
            name = f"part-{part:09d}-{number:06d}.ids"
            _put(folder, name, b"".join(blocks))
            return pa.RecordBatch.from_pydict({"name": [name], "bytes": [sum(map(len, blocks))]})

        for batch in slices(batches, "text"):
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                names.append(key)
                ids.append(np.concatenate([tokens.encode(value), end]))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    file.append(encode_block(names, ids))
                    names, ids, held = [], [], 0
                    if sum(map(len, file)) >= FILE_BYTES:
                        yield flush(file, number)
                        file, number = [], number + 1
        if names:
            file.append(encode_block(names, ids))
        if file:
            yield flush(file, number)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(write, "name string, bytes long"), "token-files")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The documents of the files listed in ``files``: name, position in the file, doc_id, ids.

    ``ids`` holds unsigned 32-bit little-endian numbers.
    """

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name, at = path.rsplit("/", 1)[-1], 0
                for keys, nulls, sizes, ids in decode_blocks(content.as_buffer().to_pybytes()):
                    ends = np.cumsum(sizes, dtype=np.int64)
                    raw = ids.astype("<u4").tobytes()
                    step = 256
                    for a in range(0, len(keys), step):
                        b = min(a + step, len(keys))
                        yield pa.RecordBatch.from_pydict({
                            "name": [name] * (b - a),
                            "position": pa.array(range(at + a, at + b), pa.int64()),
                            "doc_id": pa.array(keys[a:b], pa.int64(), mask=nulls[a:b]),
                            "ids": pa.array([raw[4 * (e - s) : 4 * e] for e, s in zip(ends[a:b].tolist(), sizes[a:b].tolist())], pa.binary()),
                        })
                    at += len(keys)

    content = spark.read.format("binaryFile").load(folder).select("path", "content")
    documents = content.mapInArrow(read, "name string, position long, doc_id long, ids binary")
    return documents.join(files.select("name"), "name", "left_semi")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write files, read them back, and give per document its place, size and checksum.

    ``start`` counts the ids of all documents before it, in the order of the files.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    files = write_token_files(docs, tokenizer, folder, end_id)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_token_files(spark, folder, files)
    small = stage(rows.select(
        "name", "position", "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    ), "token-digest")
    in_file = Window.partitionBy("name").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file meets in one task here, never one per document.
    by_file = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    totals = small.groupBy("name").agg(F.sum("n_tokens").alias("in_file"))
    bases = totals.select("name", F.coalesce(F.sum("in_file").over(by_file), F.lit(0)).alias("base"))
    placed = small.withColumn("before", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
    return placed.join(bases, "name").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
