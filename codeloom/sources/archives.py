"""Entries of ZIP archives, read by seek in ranges of the archives' directories.

One task reads an archive's directory, which says where each entry stands, and deals the wanted entries
into ranges of some megabytes. Ranges are then read by as many tasks as there are: an archive is
never read whole, whatever its size, and entries that nobody wants are never read.
"""

from __future__ import annotations

import bz2
import lzma
import math
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.session import staged

RANGE_BYTES = 32 << 20  # packed bytes of a range
RANGE_ENTRIES = 2_000
MOST_TASKS = 20_000  # beyond, a task reads several ranges
TASKS_A_CORE = 4  # at least, if there are as many ranges
_BATCH_BYTES = 32 << 20  # unpacked bytes handed on at a time

_ENTRY = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("at", T.LongType()), T.StructField("packed", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("method", T.IntegerType()), T.StructField("crc", T.LongType()),
    T.StructField("locked", T.BooleanType())])
_RANGES = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("no", T.IntegerType()), T.StructField("entries", T.ArrayType(_ENTRY))])
_CONTENTS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def open_file(path: str, mode: str = "rb"):
    """A file that can be sought in: of this machine's paths, or of any store that Arrow knows."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme or scheme == "file":
        return open(rest[rest.rfind("//") + 1 if rest.startswith("//") else 0:] if scheme == "file" else path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if mode == "rb" else store.open_output_stream(inner)


def _entry(info: zipfile.ZipInfo) -> dict:
    return {"path": info.filename, "at": info.header_offset, "packed": info.compress_size, "size": info.file_size,
            "method": info.compress_type, "crc": info.CRC, "locked": bool(info.flag_bits & 1)}


def _ranges(entries: Iterable[dict], range_bytes: int) -> Iterator[list[dict]]:
    part, held = [], 0
    for entry in sorted(entries, key=lambda e: e["at"]):
        if part and (held + entry["packed"] > range_bytes or len(part) >= RANGE_ENTRIES):
            yield part
            part, held = [], 0
        part.append(entry)
        held += entry["packed"]
    if part:
        yield part


def entry_ranges(archives: DataFrame, path: str = "path", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``(archive, no, entries)`` of the archives whose paths are given; directories are left out."""
    arrow = to_arrow_schema(_RANGES)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with open_file(archive) as file, zipfile.ZipFile(file) as box:
                    entries = [_entry(i) for i in box.infolist() if not i.is_dir()]
                for no, part in enumerate(_ranges(entries, range_bytes)):
                    yield pa.RecordBatch.from_pylist([{"archive": archive, "no": no, "entries": part}], schema=arrow)

    return archives.select(path).mapInArrow(listed, _RANGES)


def _content(file, archive: str, entry: dict) -> bytes:
    """An entry's bytes, unpacked and checked."""
    name = f"{entry['path']} in {archive}"
    if entry["locked"]:
        raise ValueError(f"{name} is encrypted")
    file.seek(entry["at"])
    header = file.read(30)
    if header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no entry where the directory says for {name}")
    names, extra = struct.unpack("<HH", header[26:30])
    file.seek(entry["at"] + 30 + names + extra)
    packed = file.read(entry["packed"])
    if entry["method"] == zipfile.ZIP_STORED:
        data = packed
    elif entry["method"] == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(packed, -15)
    elif entry["method"] == zipfile.ZIP_BZIP2:
        data = bz2.decompress(packed)
    elif entry["method"] == zipfile.ZIP_LZMA:
        size = struct.unpack("<H", packed[2:4])[0]
        options = lzma._decode_filter_properties(lzma.FILTER_LZMA1, packed[4:4 + size])
        data = lzma.decompress(packed[4 + size:], lzma.FORMAT_RAW, filters=[options])
    else:
        raise NotImplementedError(f"packing method {entry['method']} of {name}")
    if zlib.crc32(data) != entry["crc"]:
        raise zipfile.BadZipFile(f"checksum of {name}")
    return data


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Rows ``(archive, path, content)`` of the entries of ``entry_ranges``, the ranges dealt to tasks by their work."""
    arrow = to_arrow_schema(_CONTENTS)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                with open_file(row["archive"]) as file:
                    for entry in row["entries"]:
                        data = _content(file, row["archive"], entry)
                        rows.append({"archive": row["archive"], "path": entry["path"], "content": data})
                        held += len(data)
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    known = staged(ranges, "ranges")
    # A range's row is small but its work is not, so adaptive execution must not put ranges together by size.
    # Many small ranges share a task: as many tasks as there are whole ranges' work, and some for each core.
    packed = F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["packed"])
    count, held, entries = known.agg(F.count("*"), F.sum(packed), F.sum(F.size("entries").cast("long"))).first()
    work = max(math.ceil((held or 0) / RANGE_BYTES), math.ceil((entries or 0) / RANGE_ENTRIES),
               TASKS_A_CORE * known.sparkSession.sparkContext.defaultParallelism)
    dealt = known.repartition(max(1, min(count, work, MOST_TASKS)))
    return dealt.select("archive", "entries").mapInArrow(unpacked, _CONTENTS)


def archive_paths(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The archives of files, folders and globs: rows ``(path)``; nothing of them is read."""
    return spark.read.format("binaryFile").load(paths).select("path")
