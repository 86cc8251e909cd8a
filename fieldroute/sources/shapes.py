"""Polygon shape files: records as rows with their attributes and boxes, decoded to rings only where a query asks for it."""

from __future__ import annotations

import struct
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldroute.functions.text import postal_padded
from fieldroute.operators.polygons import POINT
from fieldroute.session import shared_dir, ship

#: Fixed values of the format: header bytes, bytes of an index entry, record types that are polygons.
HEADER, ENTRY, POLYGONS = 100, 8, (5, 15, 25)
#: Records a task reads, and the bytes of them that it holds at once.
SPLIT, HELD = 4096, 16 << 20
#: The padding of a view as a share of its extent, and its least size in degrees.
PAD_SHARE, PAD_LEAST = 0.08, 0.05
BOX = ("west", "south", "east", "north")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def _read(path: str, at: int, size: int) -> bytes:
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        return f.read_at(size, at)


def _size(path: str) -> int:
    store, inner = _store(path)
    return store.get_file_info(inner).size


def _fields(path: str) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Header and record length of the attribute file, and (name, offset, width) of its fields."""
    head, width = struct.unpack("<HH", _read(path, 8, 4))
    raw, fields, at = _read(path, 32, head - 32), [], 1  # a record starts with its deletion mark
    for k in range(0, len(raw) - 31, 32):
        if raw[k] == 0x0D:
            break
        fields.append((raw[k : k + 11].split(b"\0")[0].decode("ascii"), at, raw[k + 16]))
        at += raw[k + 16]
    return head, width, fields


def read_shapes(spark: SparkSession, base: str, encoding: str = "utf-8") -> DataFrame:
    """One row a record of ``base``.shp: record (from 0), the text attributes, the box in degrees and the undecoded shape.

    The index file has 8 bytes a record, so a task knows its records by their numbers alone and reads only its ranges
    of the three files; nothing is shuffled. A filter on attributes or boxes runs before ``decoded`` and costs no decoding.
    Null shapes and records marked as deleted are left out. Attributes stay text, trimmed; blank ones are "".
    """
    ship(spark)
    count = max(0, (_size(f"{base}.shx") - HEADER) // ENTRY)
    head, width, fields = _fields(f"{base}.dbf")
    schema = T.StructType([T.StructField("record", T.LongType()), *[T.StructField(n, T.StringType()) for n, _, _ in fields], *[T.StructField(c, T.DoubleType()) for c in BOX], T.StructField("shape", T.BinaryType())])

    def records(first: int, n: int) -> Iterator[tuple]:
        index = struct.unpack(f">{2 * n}i", _read(f"{base}.shx", HEADER + ENTRY * first, ENTRY * n))
        places = [(2 * index[2 * k], 2 * index[2 * k + 1] + 8) for k in range(n)]  # both are kept in 16-bit words
        rows = _read(f"{base}.dbf", head + width * first, width * n)
        k = 0
        while k < n:
            # Neighbours are read together while they lie one after the other and fit in memory.
            end = k + 1
            while end < n and places[end][0] == sum(places[end - 1]) and sum(places[end]) - places[k][0] <= HELD:
                end += 1
            data = _read(f"{base}.shp", places[k][0], sum(places[end - 1]) - places[k][0])
            for i in range(k, end):
                at = places[i][0] - places[k][0] + 8
                row = rows[width * i : width * (i + 1)]
                shape = data[at : at + places[i][1] - 8]
                if len(shape) >= 44 and struct.unpack_from("<i", shape)[0] in POLYGONS and row[:1] != b"*":
                    yield (first + i, *[row[a : a + w].decode(encoding, "replace").strip(" \0") for _, a, w in fields], *struct.unpack_from("<4d", shape, 4), shape)
            k = end

    def read(batches):
        import pandas as pd

        for batch in batches:
            for first in batch["id"]:
                held, size = [], 0
                for r in records(int(first), min(SPLIT, count - int(first))):
                    held.append(r)
                    size += len(r[-1])
                    if size > HELD:
                        yield pd.DataFrame(held, columns=schema.names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=schema.names)

    splits = max(1, -(-count // SPLIT))
    return spark.range(0, count, SPLIT, splits).mapInPandas(read, schema)


def decoded(shapes: DataFrame) -> DataFrame:
    """The rows with ``rings`` (arrays of points x, y: outer ones run with the clock, holes against it) in place of ``shape``."""
    ship(shapes.sparkSession)

    @F.pandas_udf(f"array<array<{POINT}>>")
    def rings(blobs):
        import numpy as np

        def one(blob):
            parts, points = struct.unpack_from("<2i", blob, 36)
            starts = [*struct.unpack_from(f"<{parts}i", blob, 44), points]
            xy = np.frombuffer(blob, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            return [[{"x": float(x), "y": float(y)} for x, y in xy[a:b]] for a, b in zip(starts, starts[1:])]

        return blobs.map(one)

    return shapes.withColumn("rings", rings("shape")).drop("shape")


def unpacked(spark: SparkSession, archive: str) -> str:
    """Base path of the shape file in a zip archive: one task streams its members into the shared folder, a block at a time."""
    ship(spark)
    out = f"{shared_dir(spark)}/fieldroute/shapes-{uuid.uuid4().hex}"

    def copy(batches):
        import pandas as pd

        for _ in batches:
            source, inner = _store(archive)
            target, folder = _store(out)
            target.create_dir(folder, recursive=True)
            with source.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                members = [m for m in z.namelist() if m.lower().endswith((".shp", ".shx", ".dbf"))]
                for m in members:
                    with z.open(m) as src, target.open_output_stream(f"{folder}/shapes{PurePosixPath(m).suffix.lower()}") as dst:
                        while block := src.read(1 << 20):
                            dst.write(block)
            yield pd.DataFrame({"n": [len(members)]})

    if spark.range(0, 1, 1, 1).mapInPandas(copy, "n int").first().n != 3:
        raise ValueError(f"not one shape file with index and attributes: {archive}")
    return f"{out}/shapes"


def zip_shapes(shapes: DataFrame, wanted: DataFrame, attribute: str, postal: str = "postal_code") -> DataFrame:
    """The shapes of the wanted postal codes, decoded; attributes are padded to five digits, records beyond the first of a code go."""
    keyed = shapes.withColumn(postal, postal_padded(F.col(attribute))).join(wanted.select(postal).distinct(), postal, "left_semi")
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(postal).orderBy("record"))).where("_n = 1").drop("_n")
    return decoded(first)


def padded(low: Column, high: Column) -> Column:
    return F.greatest((high - low) * PAD_SHARE, F.lit(PAD_LEAST))


def context(boxes: DataFrame, assigned: DataFrame, key: str, postal: str = "postal_code") -> DataFrame:
    """The boxes that touch the padded extent of a key's assigned postal codes, marked where they are assigned.

    ``boxes`` has postal code and box columns, ``assigned`` (key, postal code) rows; both may repeat. Extents are
    one row a key. Boxes and extents meet on the squares of one degree that both touch, each pair once.
    """
    own = assigned.select(key, postal).distinct()
    west, south, east, north = (F.col(c) for c in BOX)
    view = own.join(boxes, postal).groupBy(key).agg(F.min(west).alias("w"), F.min(south).alias("s"), F.max(east).alias("e"), F.max(north).alias("n"))
    view = view.select(key, (F.col("w") - padded(F.col("w"), F.col("e"))).alias("w"), (F.col("s") - padded(F.col("s"), F.col("n"))).alias("s"), (F.col("e") + padded(F.col("w"), F.col("e"))).alias("e"), (F.col("n") + padded(F.col("s"), F.col("n"))).alias("n"))
    squares = lambda a, b, name: F.explode(F.sequence(F.floor(a), F.floor(b))).alias(name)
    views = view.select("*", squares(F.col("w"), F.col("e"), "i")).select("*", squares(F.col("s"), F.col("n"), "j"))
    cells = boxes.select("*", squares(west, east, "i")).select("*", squares(south, north, "j"))
    # A pair that shares several squares is kept in the one with the lower left corner of what they share.
    once = (F.floor(F.greatest("w", "west")) == F.col("i")) & (F.floor(F.greatest("s", "south")) == F.col("j"))
    near = views.join(cells, ["i", "j"]).where((west <= F.col("e")) & (east >= F.col("w")) & (south <= F.col("n")) & (north >= F.col("s")) & once)
    return near.join(own.withColumn("_own", F.lit(True)), [key, postal], "left").select(key, *boxes.columns, F.coalesce("_own", F.lit(False)).alias("is_assigned"))
