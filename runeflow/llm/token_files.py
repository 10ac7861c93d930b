"""Token ids in shard files: independent zstandard frames, a document directory and a trailing seek table.

A shard file holds, in ascending document order,

* zstandard frames, each with the ids of one document or of a part of a long one (little-endian, 2 or 4 bytes an id);
* a skippable frame with the directory: one record of document id, null flag, number of ids and number of frames each,
  after the id width;
* a skippable frame with the seek table of the public seekable format: compressed size, decompressed size and the low
  32 bits of XXH64 over the decompressed bytes of each frame, the number of frames, a flag byte, a magic number.

A reader takes the end of the file, then only the byte ranges of the documents it wants, and checks what it decompressed.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import FIRST, Memo, cut_texts, spaced
from .common import append_columns, scratch_path, written

# Fixed values of the public seekable format.
SKIPPABLE, DIRECTORY, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80

FRAME_IDS = 65_536
ROWS_PER_SHARD = 4_096
MOST_SHARDS = 10_000
_RECORD = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("frames", "<u4"), ("ids", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
#: Pieces encoded as one text: enough to share a call's cost, few enough to stay in the processor's cache.
_TOGETHER = 48


def pack(data: bytes, width: int, compressor: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    """Frames of one document's ids and their seek-table records."""
    frames, seek, step = [], [], FRAME_IDS * width
    for i in range(0, max(len(data), 1), step):
        part = data[i : i + step]
        frames.append(compressor.compress(part))
        seek.append((len(frames[-1]), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
    return b"".join(frames), np.array(seek, _SEEK).tobytes()


def tail(records: list[tuple[int, int, int, int]], seeks: list[bytes], width: int) -> bytes:
    """Directory and seek table of a shard."""
    body = struct.pack("<I", width) + np.array(records, _RECORD).tobytes()
    table = b"".join(seeks)
    foot = struct.pack("<IBI", len(table) // _SEEK.itemsize, CHECKSUMS, SEEKABLE)
    return struct.pack("<II", DIRECTORY, len(body)) + body + struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot


class Shard:
    """Random access to one shard; ``source`` is a seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        at = size - 9 - n * _SEEK.itemsize
        source.seek(at)
        self.seek = np.frombuffer(source.read(n * _SEEK.itemsize), _SEEK)
        self.offset = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        source.seek(int(self.offset[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != DIRECTORY:
            raise ValueError("no directory after the frames")
        body = source.read(length)
        self.width = struct.unpack_from("<I", body)[0]
        self.docs = np.frombuffer(body, _RECORD, offset=4)
        self.first = np.concatenate([[0], np.cumsum(self.docs["frames"], dtype=np.int64)])
        self.start = np.concatenate([[0], np.cumsum(self.docs["ids"], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document as unsigned 32-bit integers; only its frames are read."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        self.source.seek(int(self.offset[a]))
        data, parts, at = self.source.read(int(self.offset[b] - self.offset[a])), [], 0
        for f in self.seek[a:b]:
            part = self.unpack.decompress(data[at : at + int(f["packed"])], max_output_size=int(f["size"])) if f["size"] else b""
            if len(part) != f["size"] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != f["check"]:
                raise ValueError("a frame's checksum differs")
            parts.append(part)
            at += int(f["packed"])
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        """Positions of the documents of that id."""
        return np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["null"] == 0)).tolist()


class ByteEncoder:
    """Ids of whole texts as packed bytes, by a byte-level tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        top = max(vocab.values())
        self.width = 2 if top < 65_536 else 4
        self.kind = f"<u{self.width}"
        self.sizes = np.zeros(top + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)  # in a byte-level vocabulary each character stands for a byte
        self.memo = Memo(self._encode_pieces)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _encode_pieces(self, keys: list[str]) -> list[bytes]:
        out: list = [None] * len(keys)
        inner = []
        for i, k in enumerate(keys):
            if k[:1] == FIRST:
                out[i] = self._whole(k[1:])
            else:
                inner.append(i)
        groups = [inner[i : i + _TOGETHER] for i in range(0, len(inner), _TOGETHER)]
        parts = [[spaced(keys[i]) for i in group] for group in groups]
        coded = self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)
        for group, part, code in zip(groups, parts, coded, strict=True):
            ids = np.array(code.ids, np.int64)
            ends = np.cumsum([len(k.encode("utf-8")) for k in part])
            at = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1
            data, a = ids.astype(self.kind).tobytes(), 0
            for i, b in zip(group, (at * self.width).tolist(), strict=True):
                out[i] = data[a:b]
                a = b
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        lists, known = cut_texts(texts, self.memo)
        return [self._whole(t) if x is None else b"".join(map(known.__getitem__, x)) for t, x in zip(texts, lists, strict=True)]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shard_bounds(df: DataFrame, id_col: str, rows_per_shard: int = ROWS_PER_SHARD) -> list[int]:
    """Upper bounds of all shards but the last: approximate quantiles of the ids, found from that column alone."""
    n = df.select(id_col).count()
    shards = max(1, min(MOST_SHARDS, -(-n // rows_per_shard)))
    if shards == 1:
        return []
    at = F.percentile_approx(F.col(id_col), F.array(*[F.lit(k / shards) for k in range(1, shards)]), F.lit(100 * shards))
    return sorted(set(df.select(at.alias("at")).first().at or []))


def write_token_files(df: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the shards in ascending order of ``id_col`` under ``folder``.

    Returns the manifest, a written table: shard, path, bytes, docs, ids, start (ids in all shards before it). A null or
    empty text is the end id alone. A null id comes first. Rows of the same id stand together, each by itself. An empty
    table gives no files and an empty manifest. Other columns, whatever their names, are left out. Each shard is streamed
    to a file of its own name that takes its place only when whole, so a repeated task leaves the same files.
    """
    spark = df.sparkSession
    keyed = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bounds = shard_bounds(keyed, "doc_id", rows_per_shard)
    end = int(end_id)
    width_of = 4 if end > 65_535 else 2

    def make():
        coder = ByteEncoder(path)
        width = max(coder.width, width_of)
        last = np.array([end], f"<u{width}").tobytes()
        compressor = zstandard.ZstdCompressor(level=1)

        def run(texts):
            frames, seeks, counts, widths = [], [], [], []
            for data in coder.encode(texts):
                if width != coder.width:
                    data = np.frombuffer(data, coder.kind).astype(f"<u{width}").tobytes()
                data += last
                f, s = pack(data, width, compressor)
                frames.append(f)
                seeks.append(s)
                counts.append(len(data) // width)
                widths.append(width)
            return frames, seeks, counts, widths

        return run

    fields = [("frames", T.BinaryType()), ("seek", T.BinaryType()), ("ids", T.LongType()), ("width", T.IntegerType())]
    coded = append_columns(keyed, "text", fields, make, carry=["doc_id"])
    shard = F.coalesce(_bucket(F.col("doc_id"), bounds), F.lit(0))
    coded = coded.withColumn("shard", shard)
    parts = max(1, len(bounds) + 1)
    dealt = coded.repartition(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids", "seek")
    schema = "shard int, path string, bytes long, docs long, ids long"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        now, out, name = None, None, ""
        records, seeks, size, width = [], [], 0, 2

        def close():
            end_of = tail(records, seeks, width)
            out.write(end_of)
            out.close()
            fs.move(f"{root}/{name}.part", f"{root}/{shard_name(now)}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "path": [f"{folder}/{shard_name(now)}"], "bytes": [size + len(end_of)], "docs": [len(records)], "ids": [sum(r[3] for r in records)]})

        try:
            for batch in batches:
                for doc_id, frames, seek, ids, w, k in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "frames", "seek", "ids", "width", "shard")], strict=True):
                    if k != now:
                        if out is not None:
                            yield close()
                        now, name, records, seeks, size = k, uuid.uuid4().hex, [], [], 0
                        out = fs.open_output_stream(f"{root}/{name}.part")
                    width = w
                    out.write(frames)
                    size += len(frames)
                    seeks.append(seek)
                    records.append((doc_id or 0, int(doc_id is None), len(seek) // _SEEK.itemsize, ids))
            if out is not None:
                yield close()
                out = None
        finally:
            if out is not None:
                out.close()

    manifest = written(dealt.mapInArrow(put, schema), "manifest")
    # one row a shard and MOST_SHARDS at most, so one task may sum them up
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def shard_name(k: int) -> str:
    return f"tokens-{k:06d}.zst"


def _bucket(col, bounds: list[int]):
    """The number of bounds below ``col``, by halving: a tree of comparisons as deep as the bounds' logarithm."""
    if not bounds:
        return F.lit(0)

    def tree(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(col > bounds[m], tree(m + 1, b)).otherwise(tree(a, m))

    return tree(0, len(bounds))


def _read(batches, wanted: set[int] | None, fill) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, start in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "start")], strict=True):
            fs, name = _filesystem(path)
            with fs.open_input_file(name) as source:
                shard = Shard(source, size)
                ks: Iterable[int] = range(len(shard.docs)) if wanted is None else [k for i in sorted(wanted) for k in shard.find(i)]
                held, rows = 0, []
                for k in ks:
                    ids = shard.ids(k)
                    d = shard.docs[k]
                    rows.append((None if d["null"] else int(d["doc_id"]), start + int(shard.start[k]), ids))
                    held += len(ids)
                    if held > 2_000_000:
                        yield fill(rows)
                        held, rows = 0, []
                if rows:
                    yield fill(rows)


def _dealt(manifest: DataFrame) -> DataFrame:
    n = manifest.count()
    return manifest.select("path", "bytes", "start").repartition(max(1, min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism)))


def read_token_files(manifest: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """Documents of the files in ``manifest``: doc_id, start, token_ids; of ``doc_ids`` only, if given (a stated list)."""
    wanted = None if doc_ids is None else {int(i) for i in doc_ids}

    def fill(rows):
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "token_ids": pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))})

    return _dealt(manifest).mapInArrow(lambda b: _read(b, wanted, fill), "doc_id long, start long, token_ids array<int>")


def read_token_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def fill(rows):
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "n_tokens": pa.array([len(r[2]) for r in rows], pa.int64()), "ids_crc32": pa.array([zlib.crc32(r[2].tobytes()) for r in rows], pa.int64())})

    return _dealt(manifest).mapInArrow(lambda b: _read(b, None, fill), "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_folder(spark: SparkSession) -> str:
    """A folder for the files in the shared one."""
    return scratch_path(spark, "tokens")
