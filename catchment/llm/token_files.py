"""Token ids in files of independent zstandard frames with a seek table and checksums.

A file holds one frame per document, in ascending doc_id order, then two skippable frames: the
document index and, last, the seek table of the public zstandard seekable format. So the
usual tools decompress a file to its plain ids, and a reader that wants some documents reads the
two tables from the end and decompresses those documents' frames alone.

  frame             ids, little-endian, 2 bytes each if the vocabulary allows, else 4
  document index    skippable frame; a zstandard frame of: width (int64), number of documents (int64), doc_ids (int64 each), null flags (1 byte each)
  seek table        skippable frame; per frame: compressed size, size, checksum (4 bytes each), then number of frames, flags 0x80, magic
  checksum          low 4 bytes of the XXH64 of the frame's plain bytes
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_dir, staged, text_slices
from .vocabulary import default_path, default_pattern, encode_all, id_width, same_ids

# Fixed values of the public zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: Files in a manifest that is broadcast at most; about so many wanted documents of a file go to one task.
MANIFEST_ROWS, WANTED = 50_000, 100_000

MANIFEST = "file_index int, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


class FileWriter:
    """Writes one file to an open binary stream."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.ids: list[int | None] = []
        self.table: list[tuple[int, int, int]] = []
        self.n_tokens = self.n_bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.width} bytes")
        plain = ids.astype(f"<u{self.width}").tobytes()
        frame = self.pack.compress(plain)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.n_tokens += len(ids)
        self.n_bytes += len(frame)

    def close(self) -> None:
        known = np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + bytes(x is None for x in self.ids)
        index = self.pack.compress(struct.pack("<qq", self.width, len(self.ids)) + known)
        table = np.array(self.table, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        tail = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table
        self.out.write(tail)
        self.n_bytes += len(tail)


class FileReader:
    """Reads chosen documents of one file."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, io.SEEK_END)
        stream.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        start = size - 9 - 12 * frames - 8
        stream.seek(start)
        if struct.unpack("<II", stream.read(8)) != (SKIPPABLE_SEEK, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(stream.read(12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])]).astype(np.int64)
        stream.seek(int(self.offsets[-1]))
        magic, length = struct.unpack("<II", stream.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("the document index is damaged")
        self.unpack = zstandard.ZstdDecompressor()
        index = self.unpack.decompress(stream.read(length))
        self.width, n = struct.unpack("<qq", index[:16])
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=n, offset=16)
        self.nulls = np.frombuffer(index, dtype=np.uint8, count=n, offset=16 + 8 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 1])]).astype(np.int64) // self.width

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own frame only, checked against the checksum."""
        self.stream.seek(int(self.offsets[k]))
        size = int(self.table[k, 1])
        plain = self.unpack.decompress(self.stream.read(int(self.table[k, 0])), max_output_size=max(1, size))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.table[k, 2]) or len(plain) != size:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(plain, dtype=f"<u{self.width}")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, pattern: str | None = None, end_id: int = 0, width: int | None = None, files: int | None = None) -> DataFrame:
    """Encodes docs(doc_id, text, ...), writes files under path, and returns their manifest, staged.

    path is a URI that all executors can write (file, hdfs, s3 ...). Each document's ids end with
    end_id and are stored in `width` bytes each (what the vocabulary needs, if None; an id that doesn't fit
    is an error); null texts count as empty; null ids come first; rows of one id are kept, ordered by
    text; other columns are not read. Documents are dealt by ranges of doc_id, one task and one
    file per range, `files` in all (spark.sql.shuffle.partitions if None); empty ranges write none. A file
    is written under a name of its own and then moved, so a task that runs twice leaves one whole file.
    """
    spark = docs.sparkSession
    tokenizer, pattern = tokenizer or default_path("byte_bpe_50k.json"), pattern or default_pattern()
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tail, same = np.array([end_id], dtype="<u4").tobytes(), same_ids(tokenizer, pattern)
    width = width or max(id_width(tokenizer), 2 if end_id < 1 << 16 else 4)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        k = TaskContext.get().partitionId()
        name, temp = f"{root}/tokens-{k:06d}.zst", f"{root}/.{uuid.uuid4().hex}"
        writer = stream = None
        for ids, texts in text_slices(batches):
            if writer is None:
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(temp)
                writer = FileWriter(stream, width)
            encoded = encode_all([t.decode() for t in texts.to_pylist()], tokenizer, pattern, same)
            for doc_id, x in zip(ids.to_pylist(), encoded, strict=True):
                writer.add(doc_id, np.frombuffer(x + tail, dtype="<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            store.move(temp, name)
            row = [k, name, writer.ids[0], writer.ids[-1], len(writer.ids), writer.n_tokens, writer.n_bytes]
            yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    dealt = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return staged(dealt.mapInArrow(rows, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, uri: str, wanted: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the files in the manifest; start counts the ids of all documents before.

    ids_crc32 is that of the ids as little-endian 32-bit integers; ids are null without with_ids.

    With wanted(doc_id), only those documents' frames are read and decompressed: wanted ids meet
    the manifest by range, and go to the file's tasks in lists of at most WANTED. A manifest of over MANIFEST_ROWS files isn't
    broadcast; its ranges are cut at multiples of about their mean length and joined on these. A long text is one frame, held whole.
    """
    before = F.sum("n_tokens").over(Window.orderBy("file_index").rowsBetween(Window.unboundedPreceding, -1))
    placed = staged(manifest.select("file_index", "path", "first_id", "last_id", "n_docs", F.coalesce(before, F.lit(0)).alias("start")), "placed")
    n = max(1, manifest.count())
    if wanted is None:
        jobs = placed.select("path", "start", F.lit(None).cast("array<long>").alias("wanted"))
    else:
        ids, between = wanted.select("doc_id").distinct(), F.expr("doc_id BETWEEN first_id AND last_id")
        if n <= MANIFEST_ROWS:
            met = ids.join(F.broadcast(placed), between)
        else:
            step = max(1, int(placed.agg(F.expr("avg(last_id - first_id + 1)")).first()[0] or 1))
            cut = placed.withColumn("at", F.expr(f"explode(sequence(first_id div {step}L, last_id div {step}L))"))
            met = ids.withColumn("at", F.expr(f"doc_id div {step}L")).join(cut, "at").filter(between)
        jobs = met.groupBy("path", "start", F.expr(f"pmod(xxhash64(doc_id), greatest(1, n_docs div {WANTED}))")).agg(F.collect_list("doc_id").alias("wanted")).select("path", "start", "wanted")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, start, want in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with store.open_input_file(path) as stream:
                    file = FileReader(stream)
                    chosen = range(len(file.doc_ids)) if want is None else np.flatnonzero(np.isin(file.doc_ids, want) & (file.nulls == 0))
                    for part in [chosen[i : i + 500] for i in range(0, len(chosen), 500)]:
                        out = [[], [], [], [], []]
                        for k in part:
                            ids = file.ids(int(k)).astype("<u4")
                            for column, x in zip(out, (None if file.nulls[k] else int(file.doc_ids[k]), start + int(file.starts[k]), len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int64) if with_ids else None), strict=True):
                                column.append(x)
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, (*[pa.int64()] * 4, pa.list_(pa.int64())), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return jobs.repartition(n).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_dir(spark, "tokens")
    manifest = write_token_files(documents(spark, sf_dir), uri)
    return read_token_files(manifest, uri, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
