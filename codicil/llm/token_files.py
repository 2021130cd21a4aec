"""Token ids in seekable zstandard files.

A file holds one independent zstandard frame per document (its ids as little-endian unsigned 32-bit
numbers), then a skippable frame with the document ids, then the seek table: a skippable frame with
each frame's compressed size, plain size and checksum (low 32 bits of XXH64), and a footer.  A reader
takes the table from the end of the file and decompresses only the frames it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.llm.common import cut, documents, shared_path
from codicil.llm.tokens import END_ID, WORD_BPE, encoder

# Fixed values of the public zstandard seekable format, version 0.1.0, and of skippable frames.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

_END = np.array([END_ID], "<u4").tobytes()
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
MANIFEST = "shard int, file string, n_docs long, n_ids long"


def file_system(folder: str):
    """The file system and path of a folder's URI (file, s3, gs, hdfs)."""
    from pyarrow import fs

    for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("file:/", "file:///")):
        if folder.startswith(hadoop) and not folder.startswith(plain):
            folder = plain + folder[len(hadoop) :].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes frames to an open binary stream and the tables at close()."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self._out, self._zip = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._entries: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self._zip.compress(ids)
        self._out.write(packed)
        self._entries.append((len(packed), len(ids), checksum(ids)))
        self._ids.append(doc_id)

    def close(self) -> None:
        null = [i for i, x in enumerate(self._ids) if x is None]
        names = np.array([x or 0 for x in self._ids], "<i8").tobytes() + np.array([*null, len(null)], "<u4").tobytes()
        table = np.array(self._entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self._entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        for magic, body in ((SKIPPABLE_IDS, names), (SKIPPABLE_TABLE, table)):
            self._out.write(struct.pack("<II", magic, len(body)) + body)


class FrameReader:
    """Reads the tables of a seekable file, then any frame by number."""

    def __init__(self, file, size: int):
        self._file = file
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = size - 9 - 12 * n
        self.entries = np.frombuffer(self._at(table, 12 * n), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        names = self._at(int(self.starts[-1]) + 8, table - 8 - int(self.starts[-1]) - 8)
        n_null = int(np.frombuffer(names[-4:], "<u4")[0])
        null = set(np.frombuffer(names[8 * n : 8 * n + 4 * n_null], "<u4").tolist())
        self.doc_ids = [None if i in null else x for i, x in enumerate(np.frombuffer(names[: 8 * n], "<i8").tolist())]

    def _at(self, start: int, n: int) -> bytes:
        self._file.seek(start)
        return self._file.read(n)

    def frame(self, i: int) -> bytes:
        import zstandard

        e = self.entries[i]
        ids = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[i]), int(e["packed"])), max_output_size=int(e["plain"]))
        if checksum(ids) != e["check"]:
            raise ValueError(f"frame {i} is damaged")
        return ids


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = WORD_BPE, level: int = 3) -> DataFrame:
    """Encodes every whole text, appends the end id and writes the ids in ascending doc_id order.

    Returns the manifest (shard, file, n_docs, n_ids): shards ascend with doc_id, null first.  Null and
    empty texts have the end id alone; rows with equal ids follow each other by text.  Each attempt of a
    task writes a file of its own name, and the manifest, which Spark commits, names those that count.
    """

    def write(batches):
        e, files, path = None, None, None
        shard = TaskContext.get().partitionId()
        n_docs = n_ids = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if e is None:
                    e, (files, path) = encoder(tokenizer), file_system(folder)
                    files.create_dir(path, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    writer = FrameWriter(out, level)
                ids = e.encode(text.as_py()) + _END
                writer.add(doc_id, ids)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4
        if e is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], names=["shard", "file", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, only: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids): each document's ids, and how many ids all documents before it have.

    only: decompress just these documents.
    """
    wanted = None if only is None else set(only)

    def read(batches):
        for b in batches:
            for file, shard_start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, path = file_system(folder)
                with files.open_input_file(f"{path}/{file}") as f:
                    r = FrameReader(f, f.size())
                    starts = shard_start + np.concatenate([[0], np.cumsum(r.entries["plain"] // 4, dtype=np.int64)])
                    chosen = [i for i, d in enumerate(r.doc_ids) if wanted is None or d in wanted]
                    for lo in range(0, len(chosen), 1000):
                        part = chosen[lo : lo + 1000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r.doc_ids[i] for i in part], pa.int64()), pa.array(starts[part]), pa.array([r.frame(i) for i in part], pa.binary())], names=["doc_id", "start", "ids"]
                        )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("shard_start"))
    n = max(1, manifest.count())  # a row for each file: without a number, so few bytes would meet in one task
    return placed.repartition(n, "shard").select("file", "shard_start").mapInArrow(read, "doc_id long, start long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(manifest, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
