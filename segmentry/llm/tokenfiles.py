"""Token-id files: independent zstandard frames, a document index, and a trailing seek table with a checksum for each frame.

A file holds documents in ascending id order:

    data frame ...      zstandard frames, each the ids of some whole documents, little-endian, 2 or 4 bytes an id
    index frame         skippable frame 0x184D2A50: zstandard of (documents, id width, then ids, validity, tokens, frame of each document)
    seek table          skippable frame 0x184D2A5E of the zstandard seekable format: for each data frame its
                        compressed size, size and checksum (low half of XXH64 of the ids), then the number of frames,
                        the flag byte 0x80 and the magic number 0x8F92EAB1

Any zstandard tool decompresses the whole file; `TokenFile` fetches the seek table and the index from the
end and then only the frames that hold the documents asked for. Writers are Spark tasks, one file each, under a name of the attempt's own that the
result lists: an attempt that fails, or loses to another, touches no file but its own, and what it leaves is removed when the job has ended. Names bear the run's own token:
what else lies in the folder stays, files of earlier runs included.

Null and empty texts give the end id alone. Documents without an id come first and keep a null id. Rows that
repeat an id stay apart, in the order of a hash of their texts, and may be spread over files. Columns besides id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.shared import cut, in_arrow, new_path, pieces_of
from segmentry.llm.wordbpe import encoder

#: Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 18
LEVEL = 1


def opened(uri: str):
    """The file system of a URI of the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Writes documents, given in order, to a binary stream."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.compress = out, width, zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames: list[tuple[int, int, int]] = []
        self.waiting: list[bytes] = []
        self.held = 0
        self.ids, self.tokens, self.frame_of = array("q"), array("q"), array("q")
        self.valid = bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.tokens.append(len(ids))
        self.frame_of.append(len(self.frames))
        self.waiting.append(ids.astype(f"<u{self.width}").tobytes())
        self.held += len(self.waiting[-1])
        if self.held >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        import xxhash

        raw = b"".join(self.waiting)
        done = self.compress(raw)
        self.frames.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(done)
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.waiting:
            self._frame()
        n = len(self.ids)
        columns = (np.array(self.ids, "<i8"), np.frombuffer(bytes(self.valid), "u1"), np.array(self.tokens, "<u4"), np.array(self.frame_of, "<u4"))
        index = self.compress(struct.pack("<QB", n, self.width) + b"".join(c.tobytes() for c in columns))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class TokenFile:
    """Reads a file by its seek table; source has seek() and read()."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompress = source, zstandard.ZstdDecompressor().decompress
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * count, 12 * count)
        self.frames = [struct.unpack_from("<III", table, 12 * i) for i in range(count)]
        self.starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames], dtype=np.int64))).astype(np.int64)
        at = int(self.starts[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index before the seek table")
        raw = self.decompress(self._at(at + 8, length))
        n, self.width = struct.unpack_from("<QB", raw)
        self.doc_ids = np.frombuffer(raw, "<i8", n, 9)
        self.valid = np.frombuffer(raw, "u1", n, 9 + 8 * n).astype(bool)
        self.tokens = np.frombuffer(raw, "<u4", n, 9 + 9 * n)
        self.frame_of = np.frombuffer(raw, "<u4", n, 9 + 13 * n)

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        raw = self.decompress(self._at(int(self.starts[k]), self.frames[k][0]), max_output_size=self.frames[k][1])
        if len(raw) != self.frames[k][1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k][2]:
            raise ValueError(f"frame {k} doesn't have its checksum")
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, places: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of the documents at these places in the file, or of all; frames without any are not read."""
        wanted = np.arange(len(self.tokens)) if places is None else np.array(sorted(places), np.int64)
        frames, begin = np.unique(self.frame_of[wanted], return_index=True)  # frames ascend with the places
        edges = np.searchsorted(self.frame_of, [frames, frames + np.uint32(1)]).tolist()
        for k, first, last, a, b in zip(frames.tolist(), *edges, begin.tolist(), [*begin[1:].tolist(), len(wanted)]):
            ids, ends = self.frame(k), np.cumsum(self.tokens[first:last], dtype=np.int64)
            for place in wanted[a:b].tolist():
                end = int(ends[place - first])
                yield place, ids[end - int(self.tokens[place]) : end]


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write docs in ascending id order to one file a task in folder (a URI); (part, file, documents, tokens) of each file, parts in order.

    Rows are ranged by id, a hash of the text and the part of the input they come from, so that no id, and no row that is repeated very often, has to fit one task.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    keys = ["id", "hash", "source"]
    ordered = rows.withColumn("hash", F.xxhash64("text")).withColumn("source", F.spark_partition_id()).repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("id", "text")
    run = f"tokens-{uuid.uuid4().hex}"
    kinds = pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = None
        for part, texts in pieces_of(batches):
            if out is None:
                context, (system, at) = TaskContext.get(), opened(folder)
                system.create_dir(at, recursive=True)
                name = f"{run}-{context.partitionId():06d}-{uuid.uuid4().hex}.zst"
                enc = encoder(tokenizer)
                out = system.open_output_stream(f"{at}/{name}", compression=None)  # else the name would have it compress once more
                writer = TokenFileWriter(out, 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4)
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                writer.add(doc_id, np.append(enc.encode(text), np.uint32(end_id)))
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "file": name, "documents": len(writer.ids), "tokens": sum(writer.tokens)}], kinds)

    files = cut(in_arrow(ordered, work, "part int, file string, documents long, tokens long"), "token-files")
    _remove_attempts(folder, run, {r["file"] for r in files.select("file").collect()})  # a row for each file
    return files


def _remove_attempts(folder: str, run: str, listed: set[str]) -> None:
    """Delete what attempts of this run left that the job didn't take; files of other runs, and of others, bear other names."""
    from pyarrow import fs

    system, at = opened(folder)
    if system.get_file_info(at).type == fs.FileType.Directory:
        for found in system.get_file_info(fs.FileSelector(at)):
            if found.is_file and found.base_name.startswith(f"{run}-") and found.base_name not in listed:
                system.delete_file(found.path)


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, read from the files by their seek tables; ids are little-endian unsigned 32-bit integers."""
    listed = sorted(tuple(r) for r in files.select("part", "file", "tokens").collect())  # a row for each file, not for each document
    totals = np.concatenate(([0], np.cumsum([n for _, _, n in listed], dtype=np.int64))).tolist()
    plan = spark.createDataFrame([(name, start) for (_, name, _), start in zip(listed, totals)], "file string, start long")
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = opened(folder)
                size = system.get_file_info(f"{at}/{row['file']}").size
                with system.open_input_file(f"{at}/{row['file']}") as source:
                    file, start, rows, held = TokenFile(source, size), row["start"], [], 0
                    for place, ids in file.documents():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((int(file.doc_ids[place]) if file.valid[place] else None, start, len(ids), raw))
                        start, held = start + len(ids), held + len(raw)
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    return in_arrow(plan.repartition(max(1, len(listed))), work, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded, written, and read back from the files; checksums are taken of what was read."""
    folder = new_path(spark, "tokens")
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
