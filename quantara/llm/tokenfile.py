"""Token ids in Arrow files of fixed-size lists.

Documents are dealt by ranges of the id and sorted; each task encodes its documents in bounded blocks and
writes one Arrow file: record batches of two fixed-size-list columns, ``ids`` (unsigned 16 or 32 bits) and
``mask`` (bits: id or padding). Documents follow each other without gaps, each closed by id 0, and are cut
where a sequence ends; only a file's last sequence is padded. The file is not compressed, so a reader maps
it and finds sequence i of a batch at a computed address, without a copy. Which ids are whose stands in a
small companion file (doc_id, at, n_tokens; ``at`` counts from the file's first id).

A file gets its final name only when it is complete, under a name of its attempt: a retried or speculative
task can leave an orphan, never a torn or doubled file, since readers go by the names that the tasks which
count return.

Defined results: a null or empty text has the closing id only; rows that repeat an id stand next to each
other, ordered by their text; a null id comes first; an empty table gives no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantara.llm._bpe import encoder
from quantara.llm._common import small_batches
from quantara.llm._text import blocks

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE = 2048
BATCH = 64
#: Rows that the manifest may bring to the driver: one a file.
#: A file has the tokens of about so many bytes of text at most.
PART_BYTES = 256 << 20
FILES = "path string, part int, first_id long, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Packs ids into fixed-size lists and writes a record batch whenever one is full."""

    def __init__(self, sink, dtype: pa.DataType, length: int = SEQUENCE, rows: int = BATCH):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.rest, self.total = np.zeros(0, dtype.to_pandas_dtype()), 0

    def write(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        ids, full = np.concatenate([self.rest, ids]), self.length * self.rows
        for i in range(0, len(ids) - full + 1, full):
            self._batch(ids[i : i + full], full)
        self.rest = ids[len(ids) - len(ids) % full :].copy()

    def _batch(self, ids: np.ndarray, filled: int) -> None:
        mask = np.arange(len(ids)) < filled
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if n := len(self.rest):
            self._batch(np.concatenate([self.rest, np.zeros(-n % self.length, self.rest.dtype)]), n)
        self.writer.close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col="doc_id", text_col="text", length: int = SEQUENCE, parts: int | None = None) -> list:
    """Write the files under ``path`` and return the manifest, one row a file, in order of the ids."""
    spark = small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if parts is None:  # more files for more bytes
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ranged = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = _open(path)
        enc, writer, sink, index = encoder(tokenizer), None, None, None
        first, n_docs, at = None, 0, 0
        dtype = pa.from_numpy_dtype(enc.ids.dtype)
        for batch in batches:
            for block in blocks(batch.column(1), 1 << 21):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    first = batch.column(0)[0].as_py()
                    sink, index_sink = (files.open_output_stream(f"{root}/{name}.{x}.tmp") for x in ("ids", "docs"))
                    writer, index = SequenceWriter(sink, dtype, length), pa.ipc.new_file(index_sink, DOCS)
                ids, counts = enc.encode(block)
                out = np.zeros(len(ids) + block.n, ids.dtype)
                closing = np.cumsum(counts + 1) - 1
                out[np.delete(np.arange(len(out)), closing)] = ids
                writer.write(out)
                starts = at + closing - counts
                index.write_batch(pa.record_batch([batch.column(0).slice(block.first, block.n), pa.array(starts), pa.array(counts + 1)], schema=DOCS))
                at, n_docs = at + len(out), n_docs + block.n
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            for x in ("ids", "docs"):
                files.move(f"{root}/{name}.{x}.tmp", f"{root}/{name}.{x}.arrow")
            yield pa.record_batch([[f"{path}/{name}"], pa.array([part], pa.int32()), pa.array([first], pa.int64()), [n_docs], [at]], ["path", "part", "first_id", "n_docs", "n_tokens"])

    return sorted(ranged.mapInArrow(run, FILES).collect(), key=lambda r: r["part"])


class TokenFile:
    """Random access to one file: ``sequence(i)`` without a copy, ``ids(a, b)`` across sequences."""

    def __init__(self, path: str):
        files, at = _open(path)
        self.source = pa.memory_map(f"{at}.ids.arrow") if files.type_name == "local" else files.open_input_file(f"{at}.ids.arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows, self.last = BATCH, (-1, None)
        with files.open_input_file(f"{at}.docs.arrow") as f:
            self.docs = pa.ipc.open_file(f).read_all()

    def batch(self, i: int, column: str = "ids") -> np.ndarray:
        if self.last[0] != i:  # documents are asked for in order, so a batch is fetched once
            self.last = i, self.reader.get_batch(i)
        return self.last[1].column(column).flatten().to_numpy(zero_copy_only=column == "ids")

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(i % self.rows * self.length, (i % self.rows + 1) * self.length)
        return self.batch(i // self.rows)[at], self.batch(i // self.rows, "mask")[at]

    def ids(self, start: int, stop: int) -> np.ndarray:
        size = self.rows * self.length
        parts = [self.batch(k)[max(start - k * size, 0) : stop - k * size] for k in range(start // size, -(-stop // size))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def masked(self) -> int:
        """How many ids the masks admit."""
        return sum(int(self.batch(k, "mask").sum()) for k in range(self.reader.num_record_batches))


def read_tokens(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files; the files are read in parallel."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0, *(r["n_tokens"] for r in manifest)])[:-1].tolist()
    files = spark.createDataFrame([(r["path"], s, r["n_tokens"]) for r, s in zip(manifest, starts, strict=True)], "path string, start long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(path)
                if file.masked() != n:
                    raise ValueError(f"{path}: the masks admit {file.masked()} ids, the manifest has {n}")
                for piece in file.docs.to_batches(max_chunksize=10_000):
                    at, count = piece.column("at").to_numpy(), piece.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(file.ids(a, a + c).astype("<u4").tobytes()) for a, c in zip(at.tolist(), count.tolist(), strict=True)]
                    yield pa.record_batch([piece.column("doc_id"), pa.array(at + start), piece.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(len(manifest)).mapInArrow(run, schema)
