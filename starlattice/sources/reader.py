"""The container as DataFrames.

``register(spark)`` adds the format ``starfits`` with the modes ``hdu``, ``cards``, ``image``, ``tiles`` and ``table``:

    spark.read.format("starfits").option("mode", "table").option("extname", "CATALOG").load("/data/*.fits")

Partitions are byte ranges of one unit (rows of a table, strips of an image, tiles), so a large file is read by many
tasks and each task reads only its unit's header and its range; options ``columns``, ``lower``, ``upper`` and ``stride``
prune before reading, and so do filters on hdu_index and extname where Spark pushes them down. Ranges are of
``partitionBytes`` (128 MB) or, of little data, so small that there are ``partitions`` (32). Of more than MANY files each
is one partition, and the driver opens none but the first. Files come by a POSIX path; :func:`from_binary` does the
same for contents that Spark read from any store.

Values of 64-bit integer images are DECIMAL(20, 0), exact whatever their offset; others are DOUBLE, exact as well
unless a fractional scale is applied.
"""

from __future__ import annotations

import glob
import io
import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from . import codecs, quantize
from .cards import Header
from .layout import BITPIX, Column, Hdu, ascii_columns, columns, heap_start, physical, read_unit, scan

ROWS = 1 << 16  # rows of a table or pixels of a strip in one batch, at least
PARTITION_BYTES, PARTITIONS, LEAST_BYTES, MANY = 128 << 20, 32, 256 << 10, 256
EXACT = T.DecimalType(20, 0)

HDU_SCHEMA = "path string, hdu_index int, kind string, extname string, extver bigint, bitpix int, naxis int, shape array<bigint>, pcount bigint, gcount bigint, tfields bigint, zimage boolean, header_start bigint, data_start bigint, data_end bigint, padded_end bigint"
CARD_SCHEMA = "path string, hdu_index int, card_index int, key string, type string, v_string string, v_int bigint, v_float double, v_bool boolean, v_re double, v_im double, comment string, raw binary"
PIXEL_SCHEMA = "path string, hdu_index int, pix bigint, x bigint, y bigint, z bigint, value double"
TILE_SCHEMA = "path string, hdu_index int, tile_id bigint, origin array<bigint>, size array<bigint>, zscale double, zzero double, values array<double>"
SPARK = {"L": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "A": T.StringType(), "E": T.FloatType(), "D": T.DoubleType()}
COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


# -- rows of each mode -----------------------------------------------------------------------------------------------
def hdu_rows(path: str, units: list[Hdu]) -> Iterator[tuple]:
    for u in units:
        h = u.header
        yield (path, u.index, u.kind, u.name, h.get("EXTVER", 1), h.get("BITPIX"), h.get("NAXIS"), u.shape, h.get("PCOUNT", 0), h.get("GCOUNT", 1), h.get("TFIELDS"), h.get("ZIMAGE") is True, u.header_start, u.data_start, u.data_end, u.padded_end)


def card_rows(path: str, units: list[Hdu]) -> Iterator[tuple]:
    for u in units:
        for i, c in enumerate(u.header.cards):
            v = c.value
            big = isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63
            yield (path, u.index, i, c.key, c.kind, v if isinstance(v, str) else str(v) if big else None, v if c.kind == "integer" and not big else None, v if c.kind == "real" else None, v if c.kind == "logical" else None, v.real if isinstance(v, complex) else None, v.imag if isinstance(v, complex) else None, c.comment, c.raw)


def is_exact(bitpix: int, scale: float, zero: float) -> bool:
    """Are the values whole numbers that a double may not hold?"""
    return bitpix == 64 and scale == 1 and float(zero).is_integer()


def unit_is_exact(u: Hdu) -> bool:
    h = u.header
    return is_exact(h.get("ZBITPIX") if u.kind == "compressed" else h.get("BITPIX"), float(h.get("BSCALE", 1)), float(h.get("BZERO", 0)))


def image_values(file: BinaryIO, u: Hdu, first: int, last: int, nulls: bool = True, exact: bool = False) -> pa.Array:
    """Physical values of pixels first to last of the unit's flat order; null where BLANK or NaN."""
    kind = np.dtype(BITPIX[u.header.get("BITPIX")])
    file.seek(u.data_start + first * kind.itemsize)
    raw = np.frombuffer(file.read((last - first) * kind.itemsize), kind)
    values, missing = physical(raw, float(u.header.get("BSCALE", 1)), float(u.header.get("BZERO", 0)), u.header.get("BLANK") if nulls and kind.kind in "iu" else None)
    return arrow_values(values, missing, exact)


def arrow_values(values: np.ndarray, missing: np.ndarray | None, exact: bool) -> pa.Array:
    """Doubles, or DECIMAL(20, 0) if the values are whole numbers of 64 bits."""
    if exact:
        gone = np.zeros(len(values), bool) if missing is None else missing
        if values.dtype == object:
            return pa.array([None if m else Decimal(int(v)) for v, m in zip(values, gone)], pa.decimal128(20, 0))
        return pa.array(values.astype(np.int64), mask=gone).cast(pa.decimal128(20, 0))
    out = values.astype(np.float64)
    return pa.array(out, mask=np.isnan(out) if missing is None else missing | np.isnan(out))


@dataclass
class Slab:
    """A hyperslab: lower (inclusive), upper (exclusive) and stride for each axis."""

    lower: list[int]
    upper: list[int]
    stride: list[int]

    @staticmethod
    def of(shape: list[int], lower=None, upper=None, stride=None) -> Slab:
        n = len(shape)
        s = Slab(list(lower or [0] * n), list(upper or shape), list(stride or [1] * n))
        if not (len(s.lower) == len(s.upper) == len(s.stride) == n) or any(not 0 <= a < b <= m or k < 1 for a, b, m, k in zip(s.lower, s.upper, shape, s.stride)):
            raise ValueError(f"slab {s} does not fit {shape}")
        return s

    def lines(self) -> int:
        return math.prod(-(-(b - a) // k) for a, b, k in zip(self.lower[1:], self.upper[1:], self.stride[1:]))

    def line(self, number: int, shape: list[int]) -> tuple[int, list[int]]:
        """Flat offset of the start of the slab's n-th line, and its place on the higher axes."""
        place, offset, step = [], 0, shape[0]
        for a, b, k, m in zip(self.lower[1:], self.upper[1:], self.stride[1:], shape[1:]):
            number, i = divmod(number, -(-(b - a) // k))
            place.append(a + i * k)
            offset += place[-1] * step
            step *= m
        return offset, place


def pixel_batches(file: BinaryIO, path: str, u: Hdu, slab: Slab, first: int, last: int, exact: bool = False) -> Iterator[pa.RecordBatch]:
    """Lines first to last of the slab; runs along the first axis are read, nothing else."""
    kind = pa.decimal128(20, 0) if exact else pa.float64()
    schema = pa.schema([("path", pa.string()), ("hdu_index", pa.int32()), *[(c, pa.int64()) for c in ("pix", "x", "y", "z")], ("value", kind)])
    a, b, k = slab.lower[0], slab.upper[0], slab.stride[0]
    xs = np.arange(a, b, k)
    held, values, size = [], [], 0

    def packed() -> pa.RecordBatch:
        pix, x, y, z = (np.concatenate([h[i] for h in held]) for i in range(4))
        paths = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(pix), np.int32)), pa.array([path])).cast(pa.string())
        return pa.RecordBatch.from_arrays([paths, pa.array(np.full(len(pix), u.index, np.int32)), *[pa.array(c) for c in (pix, x, y, z)], pa.concat_arrays(values)], schema=schema)

    for n in range(first, last):
        offset, place = slab.line(n, u.shape)
        line = image_values(file, u, offset + a, offset + b, exact=exact)
        values.append(line if k == 1 else line.take(pa.array(np.arange(0, len(line), k))))
        y, z = ([*place, 0, 0])[:2]
        held.append((offset + xs, xs, np.full(len(xs), y), np.full(len(xs), z)))
        size += len(xs)
        if size >= ROWS:
            yield packed()
            held, values, size = [], [], 0
    if held:
        yield packed()


def spark_type(c: Column) -> T.DataType:
    if c.code in "PQ":
        return T.ArrayType(COMPLEX if c.inner in "CM" else SPARK.get(c.inner, T.ShortType()))
    if c.code == "A":
        return T.StringType()
    one = COMPLEX if c.code in "CM" else T.BooleanType() if c.code == "X" else SPARK[c.code]
    if c.code not in "CMXLA":
        one = _scaled_type(c, one)
    return T.ArrayType(one) if c.repeat != 1 else one


def _scaled_type(c: Column, one: T.DataType) -> T.DataType:
    if c.scale == 1 and c.zero == 0 or c.code in "ED":
        return one
    if c.scale == 1 and float(c.zero).is_integer():
        return T.DecimalType(20, 0) if c.code == "K" else T.LongType()
    return T.DoubleType()


def table_schema(cols: list[Column]) -> T.StructType:
    meta = lambda c: {k: v for k, v in {"unit": c.unit, "tform": f"{c.repeat}{c.code}{c.inner}", "tdim": str(c.dim) if c.dim else "", "tscal": c.scale, "tzero": c.zero, "tdisp": c.display}.items() if v not in ("", None)}
    return T.StructType([T.StructField(c.name, spark_type(c), True, meta(c)) for c in cols])


def decode_cells(raw: np.ndarray, c: Column, heap=None) -> list:
    """A column of a block of rows (rows x width bytes) as Python values."""
    n = len(raw)
    part = np.ascontiguousarray(raw[:, c.offset : c.offset + c.width])
    if c.code == "A":
        # by the convention a cell that begins with NUL is undefined
        return [None if r[:1] == b"\0" else r.split(b"\0")[0].decode("ascii", "replace").rstrip() for r in map(bytes, part)]
    if c.code == "X":
        bits = np.unpackbits(part, axis=1)[:, : c.repeat].astype(bool).tolist()
        return bits if c.repeat != 1 else [b[0] for b in bits]
    if c.code in "PQ":
        pairs = part.reshape(n, -1).view(">i4" if c.code == "P" else ">i8").reshape(n, -1)
        inner = Column(c.name, c.inner, 1, 0, 0, c.scale, c.zero, c.null)
        out = []
        for count, offset in pairs[:, :2].tolist():
            size = max(ELEMENT_BYTES.get(c.inner, 1), 1)
            block = np.frombuffer(heap(offset, count * size), np.uint8)
            inner.width = size
            out.append(decode_cells(block.reshape(count, size), inner) if count else [])
        return out
    kind = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">f4", "M": ">f8"}[c.code]
    values = part.reshape(-1).view(kind)
    if c.code == "L":
        cells = [True if v == 84 else False if v == 70 else None for v in values.tolist()]
    elif c.code in "CM":
        cells = [{"re": float(a), "im": float(b)} for a, b in values.reshape(-1, 2).tolist()]
    else:
        scaled, missing = physical(values, c.scale, c.zero, c.null if c.code in "BIJK" else None)
        cells = scaled.tolist()
        if missing is not None and c.code in "BIJK":
            cells = [None if m else v for v, m in zip(cells, missing.tolist())]
    return cells if c.repeat == 1 else [cells[i * c.repeat : (i + 1) * c.repeat] for i in range(n)]


ELEMENT_BYTES = {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16}


def table_batches(file: BinaryIO, u: Hdu, cols: list[Column], wanted: list[str], first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Rows first to last of a binary table; only wanted columns are decoded."""
    width = u.shape[0]
    picked = [c for c in cols if c.name in wanted]
    picked.sort(key=lambda c: wanted.index(c.name))
    base = heap_start(u)

    def heap(offset: int, size: int) -> bytes:
        file.seek(base + offset)
        return file.read(size)

    for at in range(first, last, ROWS):
        n = min(ROWS, last - at)
        file.seek(u.data_start + at * width)
        raw = np.frombuffer(file.read(n * width), np.uint8).reshape(n, width)
        yield _record(picked, [decode_cells(raw, c, heap) for c in picked])


def _record(cols: list[Column], cells: list[list]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(table_schema(cols))
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cells, schema)], schema=schema)


def ascii_schema(cols: list[Column]) -> T.StructType:
    kinds = {"A": T.StringType(), "I": T.LongType(), "F": T.DoubleType()}
    return T.StructType([T.StructField(c.name, kinds[c.code] if c.code != "I" or (c.scale == 1 and c.zero == 0) else T.DoubleType()) for c in cols])


def ascii_batch(file: BinaryIO, u: Hdu, cols: list[Column], wanted: list[str], first: int, last: int) -> pa.RecordBatch:
    width = u.shape[0]
    file.seek(u.data_start + first * width)
    lines = file.read((last - first) * width)
    arrays, names = [], []
    for c in sorted((c for c in cols if c.name in wanted), key=lambda c: wanted.index(c.name)):
        texts = [lines[i * width + c.offset : i * width + c.offset + c.width].decode("ascii", "replace") for i in range(last - first)]
        null = str(c.null).strip() if c.null is not None else None
        if c.code == "A":
            arrays.append(pa.array([t.rstrip() for t in texts], pa.string()))
        else:
            scaled = c.scale != 1 or c.zero != 0
            number = (lambda t: float(t.upper().replace("D", "E"))) if c.code == "F" else int
            values = [None if not t.strip() or t.strip() == null else number(t.strip()) for t in texts]
            if scaled:
                values = [None if v is None else v * c.scale + c.zero for v in values]
            arrays.append(pa.array(values, pa.int64() if c.code == "I" and not scaled else pa.float64()))
        names.append(c.name)
    return pa.RecordBatch.from_arrays(arrays, names)


# -- compressed images -----------------------------------------------------------------------------------------------
@dataclass
class Tiling:
    shape: list[int]
    tile: list[int]
    codec: str
    bitpix: int
    params: dict[str, int]
    method: int
    seed: int
    blank: int | None
    scale: float
    zero: float

    @staticmethod
    def of(header: Header) -> Tiling:
        n = int(header.get("ZNAXIS"))
        shape = [int(header.get(f"ZNAXIS{i + 1}")) for i in range(n)]
        tile = [int(header.get(f"ZTILE{i + 1}", shape[0] if i == 0 else 1)) for i in range(n)]
        params = {}
        for i in range(1, 100):
            if f"ZNAME{i}" not in header:
                break
            params[str(header.get(f"ZNAME{i}")).upper()] = int(float(header.get(f"ZVAL{i}", 0)))
        method = {"SUBTRACTIVE_DITHER_1": quantize.DITHER_1, "SUBTRACTIVE_DITHER_2": quantize.DITHER_2}.get(str(header.get("ZQUANTIZ", "")).strip(), quantize.NONE)
        return Tiling(shape, tile, str(header.get("ZCMPTYPE")).strip(), int(header.get("ZBITPIX")), params, method, int(header.get("ZDITHER0", 1)), header.get("ZBLANK"), float(header.get("BSCALE", 1)), float(header.get("BZERO", 0)))

    def box(self, number: int) -> tuple[list[int], list[int]]:
        """Origin and size of a tile, cut at the image's edge."""
        origin, size = [], []
        for m, t in zip(self.shape, self.tile):
            number, i = divmod(number, -(-m // t))
            origin.append(i * t)
            size.append(min(t, m - i * t))
        return origin, size

    def decode(self, number: int, row: dict) -> tuple[np.ndarray, np.ndarray | None, float | None, float | None]:
        """Physical values of a tile, where they are missing, and the tile's scale and zero."""
        _, size = self.box(number)
        count = math.prod(size)
        zscale, zzero = row.get("ZSCALE"), row.get("ZZERO")
        blank = row.get("ZBLANK", self.blank)
        width = abs(self.bitpix) // 8
        if row.get("COMPRESSED_DATA"):
            words = 4 if self.bitpix < 0 and zscale is not None else width
            words = self.params.get("BYTEPIX", 4 if self.codec.startswith("RICE") else words) if self.codec.startswith("RICE") else words
            values = codecs.decode(row["COMPRESSED_DATA"], self.codec, count, words, self.params.get("BLOCKSIZE", 32)) if self.bitpix > 0 or zscale is not None else np.frombuffer(codecs.unshuffle(codecs.inflate(row["COMPRESSED_DATA"]), width) if self.codec == "GZIP_2" else codecs.inflate(row["COMPRESSED_DATA"]), BITPIX[self.bitpix], count)
            if zscale is not None:
                out = quantize.dequantize(values, zscale, zzero, self.method, number + self.seed)
                return out, (values == (quantize.NULL if blank is None else blank)) | np.isnan(out), zscale, zzero
        else:
            raw = row.get("UNCOMPRESSED_DATA") or codecs.inflate(row["GZIP_COMPRESSED_DATA"])
            values = np.frombuffer(raw, BITPIX[self.bitpix], count)
        out, missing = physical(np.asarray(values), self.scale, self.zero, blank if self.bitpix > 0 else None)
        return out, missing, None, None


def tile_rows(file: BinaryIO, path: str, u: Hdu, first: int, last: int, exact: bool = False) -> Iterator[tuple]:
    tiling, cols = Tiling.of(u.header), columns(u.header)
    base, width = heap_start(u), u.shape[0]
    for n in range(first, last):
        file.seek(u.data_start + n * width)
        raw = np.frombuffer(file.read(width), np.uint8).reshape(1, width)
        row: dict = {}
        for c in cols:
            if c.code in "PQ":
                count, offset = raw[0, c.offset : c.offset + c.width].view(">i4" if c.code == "P" else ">i8")[:2].tolist()
                file.seek(base + offset)
                row[c.name.upper()] = file.read(count * ELEMENT_BYTES[c.inner])
            else:
                row[c.name.upper()] = decode_cells(raw, c)[0]
        values, missing, scale, zero = tiling.decode(n, row)
        origin, size = tiling.box(n)
        yield (path, u.index, n, origin, size, scale, zero, arrow_values(values, missing, exact).to_pylist())


# -- the data source -------------------------------------------------------------------------------------------------
def typed(schema: str, exact: bool) -> str:
    """The schema of pixels or tiles with their kind of values."""
    return schema.replace("value double", "value decimal(20,0)").replace("values array<double>", "values array<decimal(20,0)>") if exact else schema


FIXED = {"hdu": HDU_SCHEMA, "cards": CARD_SCHEMA, "image": PIXEL_SCHEMA, "tiles": TILE_SCHEMA}
FITTING = {"image": ("primary", "image"), "tiles": ("compressed",), "table": ("bintable", "ascii_table")}


def pick(units: list[Hdu], options: dict, mode: str) -> Hdu:
    """By number, by name (the first match), else the first unit of a fitting kind that has data."""
    if "hdu" in options:
        return units[int(options["hdu"])]
    name, kinds = options.get("extname"), FITTING[mode]
    for u in units:
        if (u.name == name) if name else (u.kind in kinds and u.data_end > u.data_start):
            return u
    raise ValueError(f"no unit {name or kinds}")


def schema_of(units: list[Hdu], options: dict, mode: str) -> T.StructType | str:
    if mode in ("hdu", "cards"):
        return FIXED[mode]
    u = pick(units, options, mode)
    if mode in FIXED:
        return typed(FIXED[mode], unit_is_exact(u))
    full = ascii_schema(ascii_columns(u.header)) if u.kind == "ascii_table" else table_schema(columns(u.header))
    wanted = options.get("columns")
    return full if not wanted else T.StructType([full[c.strip()] for c in wanted.split(",")])


def slab_of(u: Hdu, options: dict) -> Slab:
    numbers = lambda key: [int(t) for t in options[key].split(",")] if key in options else None
    return Slab.of(u.shape, numbers("lower"), numbers("upper"), numbers("stride"))


def steps_of(u: Hdu, options: dict, mode: str) -> tuple[int, int]:
    """How many lines, tiles or rows a unit has, and about how many bytes each takes."""
    if mode == "image":
        slab = slab_of(u, options)
        return slab.lines(), (slab.upper[0] - slab.lower[0]) * abs(u.header.get("BITPIX")) // 8
    return u.shape[1], max(1, (u.data_end - u.data_start) // max(1, u.shape[1]))


def read_range(file: BinaryIO, path: str, u: Hdu, options: dict, mode: str, names: list[str], exact: bool, first: int, last: int):
    """Rows or record batches of a range of one unit."""
    if mode in ("image", "tiles") and unit_is_exact(u) and not exact:
        raise ValueError(f"{path} holds 64-bit integers, which the first file's value column cannot hold: read them apart")
    if mode == "image":
        yield from pixel_batches(file, path, u, slab_of(u, options), first, last, exact)
    elif mode == "tiles":
        yield from tile_rows(file, path, u, first, last, exact)
    elif u.kind == "ascii_table":
        for at in range(first, last, ROWS):
            yield ascii_batch(file, u, ascii_columns(u.header), names, at, min(last, at + ROWS))
    else:
        yield from table_batches(file, u, columns(u.header), names, first, last)


def is_exact_schema(schema: T.StructType) -> bool:
    last = schema.fields[-1].dataType
    return last == EXACT or last == T.ArrayType(EXACT)


@dataclass
class Part(InputPartition):
    """A range of one unit, or a whole file (index -1)."""

    path: str
    index: int
    start: int
    first: int
    last: int

    def __post_init__(self):
        self.value = None


class StarFits(DataSource):
    """Options: mode, extname or hdu (a number), columns, lower, upper, stride (comma-separated), partitionBytes, partitions."""

    @classmethod
    def name(cls) -> str:
        return "starfits"

    def mode(self) -> str:
        return self.options.get("mode", "hdu")

    def paths(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return found

    def schema(self):
        if self.mode() in ("hdu", "cards"):
            return FIXED[self.mode()]
        with open(self.paths()[0], "rb") as file:
            return schema_of(scan(file), self.options, self.mode())

    def reader(self, schema):
        return _Reader(self, schema)

    def writer(self, schema, overwrite):
        from .writer import TableWriter

        return TableWriter(dict(self.options), schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, source: StarFits, schema: T.StructType):
        self.options, self.names, self.mode = dict(source.options), schema.fieldNames(), source.mode()
        self.files, self.exact = source.paths(), is_exact_schema(schema) if source.mode() in ("image", "tiles") else False
        self.only: dict[str, object] = {}

    def pushFilters(self, filters):
        """Equality on hdu_index or extname is decided by the reader; other filters stay with Spark."""
        for f in filters:
            if self.mode in ("hdu", "cards") and isinstance(f, EqualTo) and f.attribute in (("hdu_index",), ("extname",)) and (self.mode == "hdu" or f.attribute == ("hdu_index",)):
                self.only[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Part]:
        if self.mode in ("hdu", "cards") or len(self.files) > MANY:
            return [Part(p, -1, 0, 0, 0) for p in self.files]

        def unit(path: str) -> Hdu:
            with open(path, "rb") as file:
                return pick(scan(file), self.options, self.mode)

        with ThreadPoolExecutor(16) as pool:
            units = list(pool.map(unit, self.files))
        sizes = [steps_of(u, self.options, self.mode) for u in units]
        whole = sum(n * width for n, width in sizes)
        most = int(self.options.get("partitionBytes", PARTITION_BYTES))
        aim = min(most, max(LEAST_BYTES, whole // int(self.options.get("partitions", PARTITIONS))))
        out = []
        for path, u, (total, width) in zip(self.files, units, sizes):
            step = max(1, aim // max(1, width))
            out += [Part(path, u.index, u.header_start, a, min(a + step, total)) for a in range(0, total, step)]
        return out

    def read(self, part: Part | None):
        if part is None:  # a table without rows has no partitions
            return
        with open(part.path, "rb") as file:
            if self.mode in ("hdu", "cards"):
                units = [u for u in scan(file) if self.only.get("hdu_index", u.index) == u.index and self.only.get("extname", u.name) == u.name]
                yield from (hdu_rows if self.mode == "hdu" else card_rows)(part.path, units)
                return
            if part.index < 0:
                u = pick(scan(file), self.options, self.mode)
                first, last = 0, steps_of(u, self.options, self.mode)[0]
            else:
                u, first, last = read_unit(file, part.start, part.index), part.first, part.last
            yield from read_range(file, part.path, u, self.options, self.mode, self.names, self.exact, first, last)


def register(spark: SparkSession) -> None:
    """Add the format; Spark asks Python sources for filters only where that is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StarFits)


def from_binary(files: DataFrame, mode: str = "hdu", **options: str) -> DataFrame:
    """Any mode over files that Spark's binaryFile reader read from any store (columns path and content).

    Options are those of the data source. The schema of images, tiles and tables is that of the first file.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if mode in ("hdu", "cards"):
        schema = T._parse_datatype_string(FIXED[mode])
    else:

        def describe(batches):
            for batch in batches:
                for content in batch.column("content"):
                    found = schema_of(scan(io.BytesIO(content.as_py())), options, mode)
                    yield pa.RecordBatch.from_pydict({"schema": [found if isinstance(found, str) else found.json()]})

        text = files.orderBy("path").limit(1).select("content").mapInArrow(describe, "schema string").first()[0]
        schema = T.StructType.fromJson(json.loads(text)) if text.startswith("{") else T._parse_datatype_string(text)
    arrow, names, exact = to_arrow_schema(schema), schema.fieldNames(), mode in ("image", "tiles") and is_exact_schema(schema)

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                file = io.BytesIO(content.as_py())
                units = scan(file)
                if mode in ("hdu", "cards"):
                    made = list((hdu_rows if mode == "hdu" else card_rows)(path, units))
                    if made:
                        yield rows(made)
                    continue
                u = pick(units, options, mode)
                for item in read_range(file, path, u, options, mode, names, exact, 0, steps_of(u, options, mode)[0]):
                    yield item if isinstance(item, pa.RecordBatch) else rows([item])

    return files.select("path", "content").mapInArrow(run, schema)


#: What a target type takes without loss of range: integers take images of at most their width, floats take all.
_TAKES = {"tinyint": (8,), "smallint": (8, 16), "int": (8, 16, 32), "bigint": (8, 16, 32, 64), "float": (8, 16, 32, 64, -32, -64), "double": (8, 16, 32, 64, -32, -64)}


def can_convert(bitpix: int, target: str) -> bool:
    """May pixels of that BITPIX be read as a Spark type (tinyint, smallint, int, bigint, float or double)?"""
    return bitpix in _TAKES.get(target, ())


def convert(pixels: DataFrame, bitpix: int, target: str) -> DataFrame:
    """``pixels`` with ``value`` of the target type; TypeError where the matrix of :func:`can_convert` says no."""
    if not can_convert(bitpix, target):
        raise TypeError(f"pixels of BITPIX {bitpix} cannot be read as {target}")
    return pixels.withColumn("value", pixels["value"].cast(target))


def read_float32(df: DataFrame, bitpix: int) -> DataFrame:
    """Pixels of integer images scaled to [0, 1] over the type's range; floats as they are."""
    ranges = {8: (0.0, 255.0), 16: (-32768.0, 65535.0), 32: (-2147483648.0, 4294967295.0), 64: (-9.223372036854775808e18, 1.8446744073709551615e19)}
    if bitpix < 0:
        return df.withColumn("value", df["value"].cast("float"))
    low, span = ranges[bitpix]
    return df.withColumn("value", ((df["value"] - low) / span).cast("float"))


def frame_rgb(pixels: DataFrame) -> DataFrame:
    """Three planes as columns r, g, b."""
    from pyspark.sql import functions as F

    plane = lambda z: F.max(F.when(F.col("z") == z, F.col("value")))
    return pixels.groupBy("x", "y").agg(plane(0).alias("r"), plane(1).alias("g"), plane(2).alias("b"))
