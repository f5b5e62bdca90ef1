"""Token ids in files of transposed, compressed blocks.

A file holds the ids of a run of documents, one after the other, cut into chunks of CHUNK ids. The ids of a chunk are
transposed into planes: plane b holds bit b (or byte b) of every id, as many planes as the chunk's greatest id needs. Planes are
compressed one by one with zstandard. At a file's end stand the compressed tables of its documents and of its chunks (place,
number of ids, sizes of the planes), and a footer that finds them, so any stretch of ids is read without the rest.

`register(spark)` makes this a Spark data source: `df.write.format("token_planes")` and `spark.read.format("token_planes")`.
Each task writes a file under a name of its own; only the driver's commit lists the files that count, so what a lost or repeated
attempt leaves behind is never read. Paths are those of a file system that every executor reaches.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import chain, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from prumo.llm.common import once_per_worker

FORMAT = "token_planes"
MAGIC = b"TPLANES1"
MANIFEST = "_manifest.json"
CHUNK = 1 << 16  # ids in a chunk
BATCH = 1 << 20  # ids in a batch read back, if no single document has more
LEVEL = 3  # of zstandard
REMEMBERED = 800_000  # pieces whose ids a worker keeps
AT_ONCE = 50_000  # pieces given to the library in one call
# Any character outside these scripts, whose classes have been fixed since early versions of Unicode: Latin, Cyrillic, punctuation,
# currency, kana, Han and Hangul.
UNSETTLED = regex.compile("[^\u0000-\u02ff\u0400-\u0481\u048a-\u0513\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3094\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]")
CHUNK_TYPE = np.dtype([("at", "<u8"), ("count", "<u4"), ("bits", "u1"), ("planes", "u1"), ("sizes", "<u4", (32,))])
DOC_TYPE = np.dtype([("id", "<i8"), ("known", "u1"), ("count", "<u8")])


def transposed(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first: bit planes (`bits` 1) or byte planes (`bits` 8)."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    as_bytes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [as_bytes[:, b].tobytes() for b in range(-(-width // 8))]
    spread = np.unpackbits(as_bytes, axis=1, bitorder="little")[:, :width]
    return [row.tobytes() for row in np.packbits(spread.T, axis=1, bitorder="little")]


def restored(planes: list[bytes], count: int, bits: int) -> np.ndarray:
    """The ids whose planes these are."""
    if bits == 8:
        out = np.zeros((count, 4), dtype=np.uint8)
        for b, plane in enumerate(planes):
            out[:, b] = np.frombuffer(plane, dtype=np.uint8)
    else:
        packed = np.array([np.frombuffer(plane, dtype=np.uint8) for plane in planes])
        spread = np.zeros((count, 32), dtype=np.uint8)
        spread[:, : len(planes)] = np.unpackbits(packed, axis=1, bitorder="little", count=count).T
        out = np.packbits(spread, axis=1, bitorder="little")
    return out.view("<u4").reshape(count)


class FileWriter:
    """Writes documents one after the other; holds one chunk of ids and 17 bytes a document."""

    def __init__(self, out, bits: int, chunk: int = CHUNK):
        self.out, self.bits, self.chunk = out, bits, chunk
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.at = 0
        self.docs: list[tuple[int, int, int]] = []
        self.chunks: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, blob: bytes) -> None:
        self.out.write(blob)
        self.at += len(blob)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.total += len(ids)
        while len(ids):
            part = ids[: self.chunk - self.held]
            self.waiting.append(part)
            self.held += len(part)
            ids = ids[len(part) :]
            if self.held == self.chunk:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.waiting)
        self.waiting, self.held = [], 0
        entry = np.zeros(1, dtype=CHUNK_TYPE)
        blobs = [self.compress(plane) for plane in transposed(ids, self.bits)]
        entry["at"], entry["count"], entry["bits"], entry["planes"] = self.at, len(ids), self.bits, len(blobs)
        entry["sizes"][0, : len(blobs)] = list(map(len, blobs))
        self.chunks.append(entry)
        self._put(b"".join(blobs))

    def close(self) -> None:
        if self.held:
            self._flush()
        docs = self.compress(np.array(self.docs, dtype=DOC_TYPE).tobytes())
        index = self.compress(b"".join(e.tobytes() for e in self.chunks))
        ends = struct.pack("<QQQ", self.at, len(docs), len(index))
        self._put(docs)
        self._put(index)
        self._put(ends + struct.pack("<I", zlib.crc32(docs + index + ends)) + MAGIC)
        self.out.close()


class FileReader:
    """Reads a file's tables, and its ids chunk by chunk."""

    def __init__(self, file):
        self.file = file
        tail = 24 + 4 + len(MAGIC)
        file.seek(file.size() - tail)
        ends, (check,), magic = file.read(24), struct.unpack("<I", file.read(4)), file.read(len(MAGIC))
        if magic != MAGIC:
            raise ValueError("no file of token planes")
        at, docs, index = struct.unpack("<QQQ", ends)
        file.seek(at)
        tables = file.read(docs + index)
        if zlib.crc32(tables + ends) != check:
            raise ValueError("a damaged index of token planes")
        self.expand = zstandard.ZstdDecompressor().decompress
        self.docs = np.frombuffer(self.expand(tables[:docs]), dtype=DOC_TYPE)
        self.chunks = np.frombuffer(self.expand(tables[docs:]), dtype=CHUNK_TYPE)
        self.starts = np.concatenate([[0], np.cumsum(self.chunks["count"], dtype=np.int64)])

    def chunk(self, n: int) -> np.ndarray:
        entry = self.chunks[n]
        self.file.seek(int(entry["at"]))
        sizes = entry["sizes"][: entry["planes"]].tolist()
        blob, planes, at = self.file.read(sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.expand(blob[at : at + size]))
            at += size
        return restored(planes, int(entry["count"]), int(entry["bits"]))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number start to stop - 1 of the file, from the chunks that hold them."""
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        first = int(np.searchsorted(self.starts, start, side="right")) - 1
        last = int(np.searchsorted(self.starts, stop, side="left"))
        found = np.concatenate([self.chunk(n) for n in range(first, last)])
        return found[start - int(self.starts[first]) : stop - int(self.starts[first])]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote."""

    order: int
    name: str
    docs: int
    ids: int


class PlanesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int, overwrite: bool):
        self.path, self.bits, self.overwrite = path, bits, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        order = TaskContext.get().partitionId()
        name = f"part-{order:05d}-{uuid4().hex}.planes"
        system, folder = _opened(self.path)
        writer = None
        for batch in batches:
            if writer is None:  # a task without rows leaves no file
                system.create_dir(folder, recursive=True)
                writer = FileWriter(system.open_output_stream(f"{folder}/{name}"), self.bits)
            for doc_id, given in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                writer.add(doc_id, np.frombuffer(given.as_buffer() if given.is_valid else b"", dtype="<u4"))
        if writer is None:
            return Written(order, "", 0, 0)
        writer.close()
        return Written(order, name, len(writer.docs), writer.total)

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the files in the order of the partitions, after those that an earlier write listed."""
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        files = [] if self.overwrite else listed(self.path)
        before = sum(f["ids"] for f in files)
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.order):
            files.append({**asdict(m), "before": before})
            before += m.ids
        written = f"{folder}/{MANIFEST}.{uuid4().hex}"
        with system.open_output_stream(written) as out:
            out.write(json.dumps(files).encode())
        system.move(written, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{folder}/{m.name}")


def listed(path: str) -> list[dict]:
    """The committed files of a folder, in order."""
    system, folder = _opened(path)
    if system.get_file_info(f"{folder}/{MANIFEST}").type != pafs.FileType.File:
        return []
    with system.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.readall())


@dataclass
class Part(InputPartition):
    """A committed file, and which of all ids are wanted of it."""

    name: str
    before: int
    start: int
    stop: int


class PlanesReader(DataSourceReader):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop

    def partitions(self) -> list[Part]:
        parts = []
        for f in listed(self.path):
            start = max(0, self.start - f["before"])
            stop = f["ids"] if self.stop is None else min(f["ids"], self.stop - f["before"])
            whole = self.start == 0 and self.stop is None
            if start < stop or whole:
                parts.append(Part(f["name"], f["before"], start, stop))
        return parts or [Part("", 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        system, folder = _opened(self.path)
        with system.open_input_file(f"{folder}/{part.name}") as file:
            reader = FileReader(file)
            ends = np.cumsum(reader.docs["count"], dtype=np.int64)
            begins = ends - reader.docs["count"].astype(np.int64)
            whole = part.start == 0 and part.stop == int(reader.starts[-1])
            # Documents without an id are part of a whole file only.
            first = 0 if whole else int(np.searchsorted(ends, part.start, side="right"))
            last = len(ends) if whole else int(np.searchsorted(begins, part.stop, side="left"))
            while first < last:
                upto = max(first + 1, min(last, int(np.searchsorted(ends, begins[first] + BATCH, side="right"))))
                starts = np.maximum(begins[first:upto], part.start)
                stops = np.minimum(ends[first:upto], part.stop)
                ids = reader.ids(int(starts[0]), int(stops[-1])).tobytes()
                offsets = (np.concatenate([starts, stops[-1:]]) - starts[0]) * 4
                blobs = pa.Array.from_buffers(
                    pa.large_binary(), upto - first, [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(ids)]
                )
                docs = reader.docs[first:upto]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs["id"].astype(np.int64), mask=docs["known"] == 0),
                        pa.array(starts + part.before),
                        blobs.cast(pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )
                first = upto


class TokenPlanes(DataSource):
    """Columns: doc_id bigint, ids binary (little-endian unsigned 32-bit), and, when reading, start bigint.

    Options: `planes`, "byte" (unless given) or "bit"; when reading, `from` and `to`, the first id and the one after the last.
    Writing in the mode "append" adds files after those listed, "overwrite" lists the new ones alone.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id bigint, start bigint, ids binary"

    def reader(self, schema: StructType) -> PlanesReader:
        stop = self.options.get("to")
        return PlanesReader(self.options["path"], int(self.options.get("from", 0)), None if stop is None else int(stop))

    def writer(self, schema: StructType, overwrite: bool) -> PlanesWriter:
        kind = self.options.get("planes", "byte")
        if kind not in ("byte", "bit"):
            raise ValueError(f"planes: byte or bit, not {kind}")
        given = {f.name: f.dataType.simpleString() for f in schema.fields}
        if given.get("doc_id") != "bigint" or given.get("ids") != "binary":
            raise ValueError(f"doc_id bigint and ids binary are to be written, not {given}")
        return PlanesWriter(self.options["path"], {"byte": 8, "bit": 1}[kind], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenPlanes)


class Encoder:
    """Encodes texts by a tokenizer of the library, remembering the ids of pieces.

    A byte-level tokenizer splits a text by its pattern and encodes each piece on its own, so a piece has the same ids
    wherever it stands. The library sees each new piece once; a text with characters whose class the library's pattern engine
    and ours may take differently is given to the library as a whole, as is every text if there is no pattern.
    """

    def __init__(self, blob: str, pattern: str | None, end: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = Tokenizer.from_str(blob)
        tokens.encode_special_tokens = True
        if pattern is not None:
            tokens.model._resize_cache(0)  # no piece is asked for twice
        self.library = tokens.encode_batch_fast
        self.split = None if pattern is None else regex.compile(pattern).findall
        self.last = [] if end is None else [end]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")

    def learn(self, pieces: list[str]) -> None:
        sizes, flat = [self.sizes], [self.flat]
        for at in range(0, len(pieces), AT_ONCE):
            ids = [e.ids for e in self.library(pieces[at : at + AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), dtype="<u4"))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(flat)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, and the end's, as little-endian unsigned 32-bit integers."""
        texts = [text or "" for text in texts]
        whole = [n for n, text in enumerate(texts) if self.split is None or UNSETTLED.search(text)]
        found = [[] if self.split is None else self.split(text) for text in texts]
        for n in whole:
            found[n] = []
        if len(self.known) > REMEMBERED:
            self.forget()
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        every = list(chain.from_iterable(found))
        pieces = np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(pieces < 0)
        met = [every[n] for n in new.tolist()]
        self.learn(list(dict.fromkeys(met)))
        pieces[new] = np.fromiter(map(self.known.__getitem__, met), np.int64, len(met))
        size, starts = self.sizes[pieces], (np.cumsum(self.sizes) - self.sizes)[pieces]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(starts - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[np.concatenate([[0], np.cumsum(counts)])]).tolist()
        last = np.array(self.last, dtype="<u4").tobytes()
        out = [ids[a:b] + last for a, b in zip(cuts, cuts[1:])]
        for n in whole:
            (e,) = self.library([texts[n]], add_special_tokens=False)
            out[n] = np.array(e.ids, dtype="<u4").tobytes() + last
        return out


def encoded(spark: SparkSession, tokenizer: str, text: Column, pattern: str | None = None, end: int | None = None) -> Column:
    """The ids of a text by the tokenizer file at `tokenizer`, then `end`, as little-endian unsigned 32-bit integers.

    `pattern` is the one by which that tokenizer itself splits texts. No special tokens are added, and their spellings in a
    text are ordinary text. A null text counts as empty. The file is read on the driver and sent to the tasks: a
    vocabulary, bounded by its file. Each task uses one thread.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    tag = uuid4().hex

    @F.arrow_udf("binary")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = once_per_worker(tag, lambda: Encoder(shared.value, pattern, end))
        for texts in batches:
            yield pa.array(encoder.encode(texts.to_pylist()), pa.binary())

    return ids_of(text)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    pattern: str | None = None,
    end: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    planes: str = "byte",
) -> None:
    """Write the ids of all texts to files at `path` in ascending order of their document's id.

    Null ids come first; rows of one id stand by a hash of their text, equal rows as they lie in the input. Texts are dealt out in
    ranges of that order and encoded where they land, so each is shuffled once and its ids never; a hot id spans ranges. A null text is empty; an empty table
    leaves a folder that reads as no rows. Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    register(spark)
    order = ["doc_id", "_hash", "_at"]
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.withColumn("_hash", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id())
    placed = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = placed.select("doc_id", encoded(spark, tokenizer, F.col("text"), pattern, end).alias("ids"))
    ids.write.format(FORMAT).mode("append").option("planes", planes).save(path)


def read_tokens(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) in the files at `path`.

    With `start` or `stop`, the parts of documents within those ids alone, read from the chunks that hold them; `start` is then where the part begins.
    """
    register(spark)
    found = spark.read.format(FORMAT).option("from", start)
    return (found if stop is None else found.option("to", stop)).load(path)


def ids_of(blob: Column) -> Column:
    """array<bigint> of little-endian unsigned 32-bit integers; null stays null."""

    @F.arrow_udf("array<bigint>")
    def listed_ids(blobs: pa.Array) -> pa.Array:
        lists = [np.frombuffer(b.as_buffer(), dtype="<u4") if b.is_valid else None for b in blobs]
        return pa.array(lists, pa.list_(pa.int64()))

    return listed_ids(blob)
