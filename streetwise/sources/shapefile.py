"""Shapefiles as a source of Spark's: ``spark.read.format("shapefile").load("/layers/areas.shp")``.

The parts lie beside each other: .shp (geometry), .shx (index), .dbf (attributes), .cpg
(encoding). A partition is a range of records, found by the index, so that a file is read
by many tasks; the driver reads headers alone. Paths are those that pyarrow's file
systems know; a plain path must be one that all executors can open.

Columns: poly_idx (record number from 0), rings, box (min_x, min_y, max_x, max_y) and the
attributes in their types. Options: ``bounds`` ("min x,min y,max x,max y") leaves out the
records whose box lies wholly beyond, without looking at their points; ``partition_bytes``
of geometry a task (8 MB). Records without a shape have null rings, and none with bounds;
records marked as deleted are left out. Of Z and M shapes x and y are read.
"""

from __future__ import annotations

import datetime
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructType

#: Fixed values of the format: file code, kinds of shape that have rings, bytes of a header and of an index entry.
FILE_CODE, POLYGONS, HEADER, ENTRY = 9994, (5, 15, 25), 100, 8
PARTITION_BYTES = 8 << 20
BOX = ("min_x", "min_y", "max_x", "max_y")


def shape_type() -> StructType:
    out = StructType().add("poly_idx", IntegerType()).add("rings", ArrayType(ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))))
    for c in BOX:
        out = out.add(c, DoubleType())
    return out


@dataclass
class Field:
    name: str
    kind: str
    start: int
    length: int
    decimals: int

    def type(self) -> DataType:
        if self.kind in "NF":
            return DoubleType() if self.decimals or self.kind == "F" or self.length > 18 else LongType()
        return {"D": DateType(), "L": BooleanType()}.get(self.kind, StringType())

    def value(self, record: bytes, encoding: str):
        """A blank, or what is not of the field's type, is null."""
        text = record[self.start : self.start + self.length].decode(encoding, "replace").strip(" \x00")
        try:
            if self.kind in "NF":
                return (float if isinstance(self.type(), DoubleType) else int)(text)
            if self.kind == "D":
                return datetime.datetime.strptime(text, "%Y%m%d").date()
        except ValueError:
            return None
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        return text or None


class Layer:
    """The parts of one shapefile."""

    def __init__(self, path: str):
        base = path[:-4] if path.lower().endswith(".shp") else path
        self.fs, self.base = pafs.FileSystem.from_uri(base) if "://" in base else (pafs.LocalFileSystem(), base.removeprefix("file:"))

    def size(self, part: str) -> int | None:
        info = self.fs.get_file_info(self.base + part)
        return info.size if info.type == pafs.FileType.File else None

    def bytes(self, part: str, start: int, n: int) -> bytes:
        with self.fs.open_input_file(self.base + part) as f:
            f.seek(start)
            return f.read(n)

    def count(self) -> int:
        if (size := self.size(".shx")) is None or self.size(".shp") is None:
            raise FileNotFoundError(f"{self.base}: .shp and .shx must be there")
        code, kind = struct.unpack(">i", self.bytes(".shp", 0, 4))[0], struct.unpack("<i", self.bytes(".shp", 32, 4))[0]
        if code != FILE_CODE or kind not in (0, *POLYGONS):
            raise ValueError(f"{self.base}.shp is not a file of polygons")
        return (size - HEADER) // ENTRY

    def encoding(self) -> str:
        if not (n := self.size(".cpg")):
            return "latin-1"
        name = self.bytes(".cpg", 0, n).decode("ascii", "replace").strip()
        return f"cp{name}" if name.isdigit() else name

    def fields(self) -> tuple[list[Field], int, int]:
        """Attributes, and the bytes of the header and of a record."""
        if self.size(".dbf") is None:
            return [], 0, 0
        head, record = struct.unpack("<HH", self.bytes(".dbf", 8, 4))
        raw, out, at = self.bytes(".dbf", 32, head - 32), [], 1
        taken = {c.lower() for c in shape_type().names}
        for i in range(0, len(raw) - 31, 32):
            if raw[i] == 0x0D:
                break
            name = raw[i : i + 11].split(b"\0")[0].decode("ascii", "replace").strip()
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            out.append(Field(name, chr(raw[i + 11]), at, raw[i + 16], raw[i + 17]))
            at += raw[i + 16]
        return out, head, record


def rings_of(content: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon's record; the corner that closes a ring is not said again."""
    parts, points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
    rings = [[tuple(p) for p in xy[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
    return [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings]


@dataclass
class Records(InputPartition):
    start: int
    end: int


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options.get("path"), int(options.get("partition_bytes", PARTITION_BYTES))
        if not self.path:
            raise ValueError("a path is needed")
        self.bounds = [float(v) for v in options["bounds"].split(",")] if options.get("bounds") else None
        if self.bounds is not None and len(self.bounds) != 4 or self.bytes < 1:
            raise ValueError("bounds are four numbers, partition_bytes at least 1")

    def partitions(self) -> list[InputPartition]:
        layer = Layer(self.path)
        n = layer.count()
        step = max(1, n * self.bytes // max(layer.size(".shp"), 1))
        return [Records(a, min(a + step, n)) for a in range(0, max(n, 1), step)]

    def read(self, partition: Records):
        layer = Layer(self.path)
        fields, head, width = layer.fields()
        encoding, n = layer.encoding(), partition.end - partition.start
        index = np.frombuffer(layer.bytes(".shx", HEADER + ENTRY * partition.start, ENTRY * n), ">i4").astype("i8").reshape(-1, 2) * 2
        table = layer.bytes(".dbf", head + width * partition.start, width * n) if fields else b""
        with layer.fs.open_input_file(layer.base + ".shp") as f:
            for i, (at, length) in enumerate(index.tolist()):
                record = table[i * width : (i + 1) * width]
                if record[:1] == b"*":
                    continue
                f.seek(at + 8)
                front = f.read(min(length, 36))
                if len(front) >= 36 and struct.unpack_from("<i", front)[0] in POLYGONS:
                    box = struct.unpack_from("<4d", front, 4)
                    if self.bounds and (box[2] < self.bounds[0] or box[0] > self.bounds[2] or box[3] < self.bounds[1] or box[1] > self.bounds[3]):
                        continue
                    rings = rings_of(front + f.read(length - 36))
                elif self.bounds:
                    continue
                else:
                    box, rings = (None,) * 4, None
                yield (partition.start + i, rings, *box, *[a.value(record, encoding) for a in fields])


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        out = shape_type()
        for f in Layer(self.options["path"]).fields()[0]:
            out = out.add(f.name, f.type())
        return out

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Shapefile)
