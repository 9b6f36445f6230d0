"""Moving work between documents and key ranges without moving every key as a row.

A *chunk* is a few megabytes of input rows kept as one compressed Arrow batch.
Corpus-wide questions ("does this phrase occur elsewhere?", "how often does this
word occur?") are asked by every chunk at once: a chunk scatters one blob per
bucket of the key space, each bucket answers all chunks, and the answers are
brought back to their chunk.  Rows shuffled are chunks x buckets, however many
keys there are; a key that is in a third of all rows is one entry per chunk.
Beyond 64 GB of text chunks and buckets grow with the root of the text, so that
their product grows with the text only, up to 64 MB and 384 MB.

Chunks are checkpointed into the shared folder before they are used twice, so
that a lost executor cannot change which rows a chunk holds.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000
BUCKET_BYTES = 12_000_000
GROWS_FROM = 64 << 30  #: bytes of text above which chunks and buckets grow with their root
MOST = 32  #: times: what a worker of four gigabytes holds
BATCH_BYTES = 8_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHUNK_SCHEMA = "chunk_id long, kind int, bucket int, n_bytes long, data binary"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder the cluster names in spark.checkpoint.dir. Where it names none: one of our own, if driver and workers are one process on one machine, else an error."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return once(df).checkpoint(eager=True)


def once(df: DataFrame) -> DataFrame:
    """``df`` as a query whose shuffle files Spark deletes when its action ends. For actions whose result is kept (a checkpoint, rows at the driver), so that nothing is computed from these files again; until the action ends they serve retries as ever."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*")  # a query has the setting that holds when it is made
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def arrow(df: DataFrame) -> DataFrame:
    """``df``, with batches to Python workers bounded in bytes: ten thousand rows of long texts don't fit a small worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def pack(data: bytes | np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""


def whole(raw: np.ndarray, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def pack_planes(a: np.ndarray) -> bytes:
    """Integers as byte planes: the high bytes of small or sorted numbers then compress to nothing."""
    return pack(planes(a)) if len(a) else b""


def unpack_planes(data: bytes, dtype: str) -> np.ndarray:
    return whole(np.frombuffer(unpack(data), np.uint8), dtype) if data else np.zeros(0, dtype)


def batch_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return pack(sink.getvalue().to_pybytes(), 3)


def bytes_batch(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(unpack(data)).read_next_batch()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one after another, and where each row's begin (one more entry than rows); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES):
    """Row ranges of about ``limit`` bytes of text; a longer document is a range of its own."""
    _, at = text_buffer(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def times(n_bytes: int) -> int:
    """How many times their least size chunks and buckets have."""
    return max(1, min(MOST, math.isqrt(n_bytes // GROWS_FROM)))


def make_chunks(df: DataFrame, text: str = "text") -> tuple[DataFrame, int, int]:
    """All rows and columns of ``df`` as chunks (kind 0), checkpointed; how many, and the bytes of text in them."""

    def pieces(batches):
        n = 0
        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"chunk_id": pa.array([base + n], pa.int64()), "kind": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()), "n_bytes": pa.array([size], pa.int64()), "data": pa.array([batch_bytes(whole)], pa.binary())})

        for batch in batches:
            for part in slices(batch, text, CHUNK_BYTES):
                more = int(text_buffer(part.column(text))[1][-1])
                if held and size + more > CHUNK_BYTES:
                    yield out()
                    n, held, size = n + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield out()

    chunks = checkpoint(arrow(df).mapInArrow(pieces, CHUNK_SCHEMA))
    n_chunks, n_bytes = measure(chunks)
    limit = times(n_bytes) * CHUNK_BYTES
    if limit == CHUNK_BYTES:
        return chunks, n_chunks, n_bytes

    def joined(batches):
        held, size, first = [], 0, None

        def out():
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"chunk_id": pa.array([first], pa.int64()), "kind": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()), "n_bytes": pa.array([size], pa.int64()), "data": pa.array([batch_bytes(batch)], pa.binary())})

        for b in batches:
            for chunk_id, more, data in zip(b.column("chunk_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("data")):
                if held and size + more > limit:
                    yield out()
                    held, size = [], 0
                if not held:
                    first = chunk_id
                held.append(bytes_batch(data.as_py()))
                size += more
        if held:
            yield out()

    chunks = checkpoint(arrow(chunks).mapInArrow(joined, CHUNK_SCHEMA))
    return chunks, measure(chunks)[0], n_bytes


def measure(chunks: DataFrame) -> tuple[int, int]:
    """Chunks, and bytes of text in them."""
    row = chunks.agg(F.count("*"), F.sum("n_bytes")).first()
    return int(row[0]), int(row[1] or 0)


def bucket_count(n_bytes: int, least: int = 48) -> int:
    """Buckets grow with the text, so that what one bucket holds is bounded."""
    return max(least, math.ceil(n_bytes / (BUCKET_BYTES * times(n_bytes))))


def row_batch(chunk_id, kind: int, buckets, datas) -> pa.RecordBatch:
    n = len(datas)
    ids = chunk_id if hasattr(chunk_id, "__len__") else [chunk_id] * n
    return pa.RecordBatch.from_pydict({"chunk_id": pa.array(ids, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "n_bytes": pa.array([0] * n, pa.int64()), "data": pa.array(datas, pa.binary())})


def scatter(chunks: DataFrame, ask) -> DataFrame:
    """``ask(batch)`` gives (bucket, blob) pairs for a chunk's rows."""

    def run(batches):
        for b in batches:
            for chunk_id, data in zip(b.column("chunk_id").to_pylist(), b.column("data")):
                found = list(ask(bytes_batch(data.as_py())))
                if found:
                    yield row_batch(chunk_id, 1, [x[0] for x in found], [x[1] for x in found])

    return arrow(chunks).mapInArrow(run, CHUNK_SCHEMA)


def answer(asked: DataFrame, reply) -> DataFrame:
    """``reply(blobs)`` answers, for one bucket, each asking chunk's blob with one blob, in order."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk_id").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        found = reply([x.as_py() for x in table.column("data")])
        return pa.Table.from_batches([row_batch(table.column("chunk_id").to_pylist(), 2, table.column("bucket").to_pylist(), found)])

    return asked.groupBy("bucket").applyInArrow(run, CHUNK_SCHEMA)


def absorb(chunks: DataFrame, replies: DataFrame, use, schema) -> DataFrame:
    """``use(batch, {bucket: blob}, chunk_id)`` yields record batches of ``schema`` from a chunk and the answers to it."""
    return absorb_kinds(chunks, [replies], lambda batch, got, chunk_id: use(batch, {b: d for (_, b), d in got.items()}, chunk_id), schema)


def absorb_kinds(chunks: DataFrame, replies: list[DataFrame], use, schema) -> DataFrame:
    """As absorb, for several rounds of answers; got: {(kind, bucket): blob}, the first round's kind being 2."""

    nothing = _empty(schema)

    def run(own: pa.Table, said: pa.Table) -> pa.Table:
        got = {(k, b): d.as_py() for k, b, d in zip(said.column("kind").to_pylist(), said.column("bucket").to_pylist(), said.column("data"))}
        out = []
        for chunk_id, data in zip(own.column("chunk_id").to_pylist(), own.column("data")):
            out += use(bytes_batch(data.as_py()), got, chunk_id)
        return pa.Table.from_batches(out) if out else nothing

    both = None
    for i, r in enumerate(replies):
        r = r.withColumn("kind", F.lit(2 + i))
        both = r if both is None else both.unionByName(r)
    # a cogroup, so that the chunks are dealt out once for all rounds of a query (the exchange is reused)
    return chunks.groupBy("chunk_id").cogroup(both.groupBy("chunk_id")).applyInArrow(run, schema)


def _empty(schema) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()


def named(df: DataFrame, names: list[str], fields: list, more: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """``names`` as the input's columns again, then ``more`` as ``outs``. A column of the input that has the name of one of ``outs`` gives way to it."""
    new = {o.lower() for o in outs}
    return df.select(*[F.col(n).alias(f.name) for n, f in zip(names, fields) if f.name.lower() not in new], *[F.col(m).alias(o) for m, o in zip(more, outs)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
