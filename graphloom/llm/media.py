"""Media columns: payloads in tar shards, rows that point into them.

A payload is stored once per shard under its SHA-256 as an 8-bit greyscale PNG
of 64 samples a row (lossless). Every writing task makes its own shards, so
nothing is shuffled to be stored, and a payload that fills a third of all rows
takes one member in each shard. Rows carry (digest, shard, offset, length);
header-only range reads then fill the metadata columns.

Recovery: the manifest is written as a table before anything reads it, and it
names only shards of the task attempts that were committed. A repeated attempt
writes shards under new names; orphans hold no live rows.

Null text counts as empty: one row of 64 zero samples. Repeated rows and equal
texts get equal values; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import new_path, stash, table

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, then the whole IHDR chunk.
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Python's file systems want it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, payload): UTF-8 and zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (WIDTH - len(raw) if not raw else -len(raw) % WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first :data:`HEADER_BYTES` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(media: bytes) -> bytes:
    width, height, _ = png_header(media)
    data, at = [], 8
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar files of at most about ``SHARD_BYTES``."""

    def __init__(self, base: str):
        self.files, self.root = fs.FileSystem.from_uri(base)
        self.files.create_dir(self.root, recursive=True)
        self.out = None

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.shard, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.files.open_output_stream(f"{self.root}/{self.shard}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        place = self.shard, self.at + len(head), len(data)
        self.at += len(head) + len(data) + -len(data) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, base: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every payload below ``base``; the manifest has id_col, n_bytes, digest, shard, offset, length.

    Lazy: write the manifest before reading from it (see :func:`media_columns`).
    """
    base = qualified(docs.sparkSession, base)
    picked = docs.select(id_col, F.col(text_col).alias("_text"))
    schema = picked.drop("_text").schema
    for name, kind in (("n_bytes", "long"), ("digest", "string"), ("shard", "string"), ("offset", "long"), ("length", "long")):
        schema = schema.add(name, kind)

    def run(batches):
        writer, known, last = None, {}, None
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, payload = payload_of(text)
                key = hashlib.sha256(payload).digest()
                if key not in known:
                    media = to_png(payload)
                    digest = hashlib.sha256(media).hexdigest()
                    writer = writer or ShardWriter(base)
                    place = writer.add(f"{digest}.png", media)
                    if place[0] != last:
                        last, known = place[0], {}
                    known[key] = (digest, *place)
                rows.append((n, *known[key]))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [batch.schema.names[0], "n_bytes", "digest", "shard", "offset", "length"])
        if writer:
            writer.close()

    return picked.mapInArrow(run, schema)


def by_shard(manifest: DataFrame) -> DataFrame:
    """Each shard's rows together and in file order, so that reads are sequential."""
    return manifest.repartition("shard").sortWithinPartitions("shard", "offset")


def _reader(base: str, schema, names: list[str], types: list, work):
    """A mapInArrow function that appends ``work(file, offset, length)``, computed once per member."""

    def run(batches):
        files, root = fs.FileSystem.from_uri(base)
        name, handle, at, got = None, None, None, None
        for batch in batches:
            rows = []
            col = {k: batch.column(batch.schema.names.index(k)).to_pylist() for k in ("shard", "offset", "length")}
            for shard, offset, length in zip(col["shard"], col["offset"], col["length"]):
                if shard != name:
                    if handle is not None:
                        handle.close()
                    name, handle, at = shard, files.open_input_file(f"{root}/{shard}"), None
                if offset != at:
                    at, got = offset, work(handle, offset, length)
                rows.append(got)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])
        if handle is not None:
            handle.close()

    return run


def fill_metadata(manifest: DataFrame, base: str) -> DataFrame:
    """Add width, height and bit_depth by reading each member's first 33 bytes only."""
    schema = T.StructType(list(manifest.schema.fields)).add("width", "long").add("height", "long").add("bit_depth", "integer")
    work = lambda f, offset, length: png_header(f.read_at(HEADER_BYTES, offset))
    return manifest.mapInArrow(_reader(qualified(manifest.sparkSession, base), schema, ["width", "height", "bit_depth"], [pa.int64(), pa.int64(), pa.int32()], work), schema)


def feature_of(payload: bytes) -> str:
    """Rows, sample sum, sum of squares, and steps between neighbours: whole numbers, so equal everywhere."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    return f"rows={len(x) // WIDTH};sum={int(x.sum())};energy={int((x * x).sum())};steps={int(np.abs(np.diff(x)).sum())}"


def read_back(manifest: DataFrame, base: str) -> DataFrame:
    """Add what the stored bytes say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = T.StructType(list(manifest.schema.fields))
    for name, kind in zip(names, ("long", "string", "long", "long", "string", "string")):
        schema = schema.add(name, kind)

    def work(f, offset, length):
        media = f.read_at(length, offset)
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)

    return manifest.mapInArrow(_reader(qualified(manifest.sparkSession, base), schema, names, types, work), schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, then fill the metadata and read every payload back."""
    base = new_path(docs.sparkSession, "media")
    manifest = stash(store(docs, base, id_col, text_col), "manifest")
    return read_back(fill_metadata(by_shard(manifest), base), base)


def tar_members(data: bytes) -> dict[str, bytes]:
    """The members of a shard by name, for inspection."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")
    return media_columns(table(spark, sf_dir, "documents")).select(*cols)
