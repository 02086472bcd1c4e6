"""Writing the container: images, tables, compressed images, copies and edits.

Nulls survive: integers get a TNULL or BLANK that no value has, strings a cell of NULs, floats NaN. A null array is an
empty one. Heaps beyond 2 GiB get 64-bit descriptors.

A file is built in a new place and moved over the old one when complete, so a crash leaves the old file whole. Edits of
headers and units work on what :func:`layout.scan` says and copy everything else byte by byte.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..durable import durable
from . import codecs, quantize
from .cards import BLOCK, Card, Header, encode_header, make_card
from .checksum import checksum, encode
from .layout import BITPIX, Hdu, scan

CODES = {T.BooleanType: "L", T.ByteType: "I", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D"}
NUMPY = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def _padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % BLOCK)


def _header(cards: Iterable[tuple], extra: Iterable[Card] = ()) -> Header:
    own = [make_card(*c) for c in cards]
    have = {c.key for c in own}
    return Header([*own, *[c for c in extra if c.key not in have or c.kind == "commentary"]])


def image_unit(values: np.ndarray, bitpix: int, primary: bool, bscale: float = 1.0, bzero: float = 0.0, blank: int | None = None, extra: Iterable[Card] = ()) -> bytes:
    """A unit from an array whose last axis runs fastest. Integers are rounded and clamped.

    NaN becomes BLANK; if none is given, the lowest integer that no pixel has (ValueError if every integer is taken).
    """
    kind = np.dtype(BITPIX[bitpix])
    v = np.asarray(values)
    if bitpix > 0 and blank is None and v.dtype.kind == "f" and np.isnan(v).any():
        blank = unused(np.unique(np.clip(np.rint((v[~np.isnan(v)].astype(np.float64) - bzero) / bscale), np.iinfo(kind).min, np.iinfo(kind).max)), kind)
    if bitpix > 0:
        if v.dtype.kind in "iu" and bscale == 1 and float(bzero).is_integer():
            scaled = v if not bzero else v.astype(object) - int(bzero)  # exact
        else:
            scaled = (v.astype(np.float64) - bzero) / bscale
        if scaled.dtype.kind == "f":
            low, high = np.iinfo(kind).min, np.iinfo(kind).max
            bad = np.isnan(scaled)
            clipped = np.clip(np.where(bad, 0.0, np.rint(scaled)), low, high)
            raw = np.where(clipped >= 2.0**63, high, np.where(clipped >= 2.0**63, 0, clipped).astype(np.int64)) if bitpix == 64 else clipped
            raw = np.where(bad, 0 if blank is None else blank, raw).astype(kind)
        else:
            raw = np.clip(scaled, np.iinfo(kind).min, np.iinfo(kind).max).astype(kind)
    else:
        raw = v.astype(kind)
    axes = [(f"NAXIS{i + 1}", n) for i, n in enumerate(v.shape[::-1])] if v.size or v.ndim else []
    cards = [("SIMPLE", True) if primary else ("XTENSION", "IMAGE"), ("BITPIX", bitpix), ("NAXIS", len(axes)), *axes]
    cards += [("EXTEND", True)] if primary else [("PCOUNT", 0), ("GCOUNT", 1)]
    cards += [("BSCALE", bscale), ("BZERO", bzero)] if (bscale, bzero) != (1, 0) else []
    cards += [("BLANK", blank)] if blank is not None else []
    return encode_header(_header(cards, extra)) + _padded(raw.tobytes())


def unused(taken: np.ndarray, kind: np.dtype) -> int:
    """The lowest integer of the kind that is not among the sorted distinct values."""
    low, high = int(np.iinfo(kind).min), int(np.iinfo(kind).max)
    for value in taken.tolist():
        if int(value) > low:
            break
        low = int(value) + 1
    if low > high:
        raise ValueError(f"no value of {kind} is left to stand for a missing one")
    return low


def empty_primary(extra: Iterable[Card] = ()) -> bytes:
    return encode_header(_header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)], extra))


def _cells(values: list, code: str, null: int | None = None) -> bytes:
    if code == "L":
        return bytes(0 if v is None else 84 if v else 70 for v in values)
    fill = np.nan if code in "ED" else null
    return np.array([fill if v is None else v for v in values], NUMPY[code]).tobytes()


def _null_of(values: list, code: str) -> int | None:
    """A TNULL for integers that hold a null."""
    if code not in "BIJK" or None not in values:
        return None
    return unused(np.unique(np.array([v for v in values if v is not None], NUMPY[code])), np.dtype(NUMPY[code]))


def table_unit(names: list[str], kinds: list[T.DataType], rows: list, extname: str = "", units: dict[str, str] | None = None, extra: Iterable[Card] = ()) -> bytes:
    """A binary table; strings take the width of the longest, arrays and binaries lie in the heap in the order of rows."""
    columns = [[r[k] for r in rows] for k in range(len(kinds))]
    heap, fields, cells, nulls = bytearray(), [], [], []
    ragged = [isinstance(k, (T.ArrayType, T.BinaryType)) for k in kinds]
    for name, kind in zip(names, kinds):
        if type(kind.elementType if isinstance(kind, T.ArrayType) else kind) not in (*CODES, T.StringType, T.BinaryType):
            raise TypeError(f"column {name}: no format holds {kind.simpleString()}")
    for kind, column, is_ragged in zip(kinds, columns, ragged):
        null = None
        if is_ragged:
            code = "B" if isinstance(kind, T.BinaryType) else CODES[type(kind.elementType)]
            null = _null_of([x for v in column if v is not None and code != "B" for x in v], code)
            places = []
            for v in column:
                data = b"" if v is None else bytes(v) if code == "B" else _cells(list(v), code, null)
                places.append((0 if v is None else len(v), len(heap)))
                heap += data
            fields.append(f"{code}({max((n for n, _ in places), default=0)})")
            cells.append(places)
        elif isinstance(kind, T.StringType):
            texts = [None if v is None else v.encode("ascii", "replace") for v in column]
            width = max((len(t) for t in texts if t is not None), default=0) or 1
            cells.append([b"\0" * width if t is None else t.ljust(width) for t in texts])
            fields.append(f"{width}A")
        else:
            code = CODES[type(kind)]
            null = _null_of(column, code)
            size, data = np.dtype(NUMPY[code]).itemsize, _cells(column, code, null)
            cells.append([data[i : i + size] for i in range(0, len(data), size)])
            fields.append(code)
        nulls.append(null)
    pointer, letter = (">i8", "Q") if len(heap) >= 1 << 31 else (">i4", "P")
    fields = [f"1{letter}{f}" if r else f for f, r in zip(fields, ragged)]
    cells = [[np.array(c, pointer).tobytes() for c in own] if r else own for own, r in zip(cells, ragged)]
    body = b"".join(b"".join(row) for row in zip(*cells)) if rows else b""
    width = sum(len(c[0]) for c in cells) if rows else sum(_empty_width(f) for f in fields)
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", len(rows)), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", len(names))]
    for i, (name, form, null) in enumerate(zip(names, fields, nulls), 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
        cards += [(f"TNULL{i}", null)] if null is not None else []
        if units and name in units:
            cards.append((f"TUNIT{i}", units[name]))
    cards += [("EXTNAME", extname)] if extname else []
    return encode_header(_header(cards, extra)) + _padded(body + bytes(heap))


def _empty_width(form: str) -> int:
    from .layout import ELEMENTS, parse_tform

    repeat, code, _ = parse_tform(form)
    return repeat * ELEMENTS[code][0]


def compress_tile(part: np.ndarray, number: int, bitpix: int, codec: str, qlevel: float, method: int, seed: int) -> tuple[int, bytes, bytes, float, float]:
    """Elements and bytes of a tile's data, the bytes of its lossless form if it cannot be quantised, scale and zero."""
    plain, scale, zero, fallback = part, 1.0, 0.0, b""
    if bitpix < 0:
        found = quantize.quantize(part.reshape(part.shape[-2] if part.ndim > 1 else 1, -1), qlevel, method, number + seed)
        if found is None:
            fallback = codecs.encode_raw(part, BITPIX[bitpix])
        else:
            plain, scale, zero = found
    size = 4 if bitpix < 0 else bitpix // 8
    data = b"" if fallback else codecs.encode(plain, codec, size, (math.prod(part.shape[:-1]), part.shape[-1]))
    return len(data) // 2 if codec == "PLIO_1" else len(data), data, fallback, scale, zero


def _tile_table(places: list, heap_size: int, shape: list[int], tile: list[int], bitpix: int, codec: str, method: int, seed: int, blank: int | None, extra: Iterable[Card]) -> tuple[bytes, bytes]:
    """Header and rows of a compressed image, from each tile's (count, offset, fallback's count, offset, scale, zero)."""
    pointer, letter = (">i8", "Q") if heap_size >= 1 << 31 else (">i4", "P")
    forms = [("COMPRESSED_DATA", f"1{letter}{'I' if codec == 'PLIO_1' else 'B'}")]
    fields = [("data", pointer, 2)]
    if bitpix < 0:
        forms += [("GZIP_COMPRESSED_DATA", f"1{letter}B"), ("ZSCALE", "1D"), ("ZZERO", "1D")]
        fields += [("fallback", pointer, 2), ("scale", ">f8"), ("zero", ">f8")]
    rows = np.zeros(len(places), np.dtype(fields))
    if places:
        own = np.array(places, np.float64) if bitpix < 0 else None
        whole = np.array([p[:4] for p in places], np.int64)
        rows["data"] = whole[:, :2]
        if bitpix < 0:
            rows["fallback"], rows["scale"], rows["zero"] = whole[:, 2:], own[:, 4], own[:, 5]
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", heap_size), ("GCOUNT", 1), ("TFIELDS", len(forms))]
    for i, (name, form) in enumerate(forms, 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    cards += [("ZIMAGE", True), ("ZCMPTYPE", codec), ("ZBITPIX", bitpix), ("ZNAXIS", len(shape))]
    cards += [(f"ZNAXIS{i + 1}", n) for i, n in enumerate(shape)] + [(f"ZTILE{i + 1}", n) for i, n in enumerate(tile)]
    if codec == "RICE_1":
        cards += [("ZNAME1", "BLOCKSIZE"), ("ZVAL1", 32), ("ZNAME2", "BYTEPIX"), ("ZVAL2", 4 if bitpix < 0 else bitpix // 8)]
    if bitpix < 0:
        names = {quantize.NONE: "NO_DITHER", quantize.DITHER_1: "SUBTRACTIVE_DITHER_1", quantize.DITHER_2: "SUBTRACTIVE_DITHER_2"}
        cards += [("ZQUANTIZ", names[method]), ("ZDITHER0", seed)]
    elif blank is not None:
        cards.append(("ZBLANK", blank))
    return encode_header(_header(cards, extra)), rows.tobytes()


def compressed_unit(image: np.ndarray, bitpix: int, codec: str = "RICE_1", tile: list[int] | None = None, qlevel: float = 4.0, method: int = quantize.DITHER_1, seed: int = 1, extra: Iterable[Card] = ()) -> bytes:
    """A tile-compressed image of integers, or of floats that are quantised tile by tile.

    A float tile that cannot be quantised is kept losslessly by gzip. Tiles default to rows; axes as in the file, first
    fastest.
    """
    shape = list(image.shape[::-1])
    tile = list(tile or [shape[0], *[1] * (len(shape) - 1)])
    counts = [-(-m // t) for m, t in zip(shape, tile)]
    heap, places = bytearray(), []
    for n in range(math.prod(counts)):
        number, where = n, []
        for m, t, c in zip(shape, tile, counts):
            number, i = divmod(number, c)
            where.append(slice(i * t, min((i + 1) * t, m)))
        count, data, fallback, scale, zero = compress_tile(image[tuple(reversed(where))], n, bitpix, codec, qlevel, method, seed)
        places.append((count, len(heap), len(fallback), len(heap) + len(data), scale, zero))
        heap += data + fallback
    header, rows = _tile_table(places, len(heap), shape, tile, bitpix, codec, method, seed, None, extra)
    return header + _padded(rows + bytes(heap))


def with_checksum(unit: bytes) -> bytes:
    """The unit with DATASUM and CHECKSUM, so that its words add up to all ones."""
    import io

    u = scan(io.BytesIO(unit if unit[:6] == b"SIMPLE" else empty_primary() + unit))[-1]
    shift = 0 if unit[:6] == b"SIMPLE" else BLOCK
    data = unit[u.data_start - shift :]
    header = u.header.set("DATASUM", str(checksum(data))).set("CHECKSUM", "0" * 16)
    blank = encode_header(header)
    return encode_header(header.set("CHECKSUM", encode(checksum(data, checksum(blank))))) + data


# -- files -----------------------------------------------------------------------------------------------------------
def write_file(path: str, units: Iterable[bytes]) -> None:
    """All units to a new file that takes the path's place when it is complete and on disk."""
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    try:
        with open(fresh, "wb") as out:
            for unit in units:
                out.write(unit)
            out.flush()
            os.fsync(out.fileno())
        os.replace(fresh, path)
    finally:
        if os.path.exists(fresh):
            os.unlink(fresh)


def unit_bytes(path: str, unit: Hdu) -> bytes:
    with open(path, "rb") as file:
        file.seek(unit.header_start)
        return file.read(unit.padded_end - unit.header_start)


def edit_file(path: str, change: Callable[[Hdu, Header], Header | None]) -> None:
    """Rewrite headers: ``change`` gives each unit's new header, the same one (copied byte by byte) or None (dropped).

    The first unit cannot be dropped.
    """
    with open(path, "rb") as file:
        units = scan(file)

    def parts():
        for u in units:
            header = change(u, u.header)
            raw = unit_bytes(path, u)
            if header is None:
                if u.index == 0:
                    raise ValueError("the first unit cannot be dropped")
            elif header is u.header:
                yield raw
            else:
                yield encode_header(header) + raw[u.data_start - u.header_start :]

    write_file(path, parts())


def overwrite_pixels(path: str, index: int, values: np.ndarray) -> None:
    """New physical values of the same shape for one image; its scaling is undone as on writing."""
    with open(path, "rb") as file:
        units = scan(file)
    u = units[index]
    if list(values.shape[::-1]) != u.shape:
        raise ValueError(f"shape {values.shape[::-1]} is not {u.shape}")
    h = u.header
    fresh = image_unit(values, h.get("BITPIX"), index == 0, float(h.get("BSCALE", 1)), float(h.get("BZERO", 0)), h.get("BLANK"))
    body = fresh[-(u.padded_end - u.data_start) :] if u.padded_end > u.data_start else b""
    write_file(path, (unit_bytes(path, v) if v.index != index else encode_header(h) + body for v in units))


#: Rows of one file that a task of the writer holds at a time.
ROWS_PER_FILE = 200_000


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class TableWriter(DataSourceArrowWriter):
    """``df.write.format("starfits").option("extname", ...).mode("append").save(folder)``: files of binary tables.

    Each task writes its rows as files of at most ``rowsPerFile`` rows under hidden names; the driver renames them when
    all tasks are done, so a failed task or job leaves nothing behind that a reader would see. The folder must be one
    that all executors share; ``overwrite`` removes the files that were there.
    """

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.folder = options["path"].removeprefix("file://").rstrip("/")
        self.extname, self.most, self.overwrite = options.get("extname", ""), int(options.get("rowsperfile", options.get("rowsPerFile", ROWS_PER_FILE))), overwrite
        self.schema, self.job = schema, uuid.uuid4().hex

    def write(self, iterator):
        context, names, kinds = TaskContext.get(), self.schema.fieldNames(), [f.dataType for f in self.schema.fields]
        os.makedirs(self.folder, exist_ok=True)
        files, held, count = [], [], 0

        def flush(rows: list) -> None:
            final = f"{self.folder}/part-{context.partitionId():05d}-{len(files):04d}-{self.job}.fits"
            hidden = f"{self.folder}/_{self.job}-{context.taskAttemptId()}-{len(files)}"
            write_file(hidden, [empty_primary(), table_unit(names, kinds, rows, self.extname)])
            files.append((hidden, final))

        for batch in iterator:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) - count >= self.most:
                flush(held[count : count + self.most])
                count += self.most
            held, count = held[count:], 0
        if held or not files and context.partitionId() == 0:
            flush(held)
        return Written(files)

    def commit(self, messages):
        old = [f for f in os.listdir(self.folder) if f.endswith(".fits")] if self.overwrite and os.path.isdir(self.folder) else []
        for m in messages:
            for hidden, final in m.files if m else []:
                os.replace(hidden, final)
        for name in old:
            os.unlink(os.path.join(self.folder, name))

    def abort(self, messages):
        for m in messages:
            for hidden, _ in m.files if m else []:
                if os.path.exists(hidden):
                    os.unlink(hidden)


def write_table(df: DataFrame, folder: str, extname: str = "") -> None:
    """The DataFrame as files of binary tables, written by the executors to a shared folder."""
    from .reader import register

    register(df.sparkSession)
    df.write.format("starfits").option("extname", extname).mode("append").save(folder)


#: Bytes of an image that one task holds at a time.
STRIP_BYTES = 16 << 20


def image_cards(shape: list[int], bitpix: int, primary: bool = True, bscale: float = 1.0, bzero: float = 0.0, blank: int | None = None) -> list[tuple]:
    """Cards of an image with these axes, the fastest first."""
    cards = [("SIMPLE", True) if primary else ("XTENSION", "IMAGE"), ("BITPIX", bitpix), ("NAXIS", len(shape)), *[(f"NAXIS{i + 1}", n) for i, n in enumerate(shape)]]
    cards += [("EXTEND", True)] if primary else [("PCOUNT", 0), ("GCOUNT", 1)]
    cards += [("BSCALE", bscale), ("BZERO", bzero)] if (bscale, bzero) != (1, 0) else []
    return cards + ([("BLANK", blank)] if blank is not None else [])


def write_image(pixels: DataFrame, path: str, shape: list[int], bitpix: int, bscale: float = 1.0, bzero: float = 0.0, blank: int | None = None, extra: Iterable[Card] = ()) -> None:
    """A file with one image from rows (pix, value): pix counts along the first axis first.

    The executors write strips of STRIP_BYTES beside the file, each from the pixels that fall into it; the driver puts
    them one after the other. Pixels that are null or have no row are missing: NaN, or BLANK, which integer images then
    need (ValueError without it). Of several rows of a pixel the largest value stays.
    """
    kind, total = np.dtype(BITPIX[bitpix]), math.prod(shape)
    strip = max(1, STRIP_BYTES // kind.itemsize)
    strips = -(-total // strip) if total else 0
    path = path.removeprefix("file://")
    stem = f"{path}.{uuid.uuid4().hex}"
    every = pixels.sparkSession.range(strips).select(F.col("id").alias("strip"), F.lit(None).cast("long").alias("pix"), F.lit(None).cast("double").alias("value"))
    rows = pixels.select(F.floor(F.col("pix") / strip).alias("strip"), F.col("pix").cast("long").alias("pix"), F.col("value").cast("double").alias("value")).filter(F.col("pix").between(0, total - 1))
    tasks = max(1, min(strips, 4 * int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.unionByName(every).repartition(tasks, "strip").sortWithinPartitions("strip", F.col("value").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        now, data = None, np.zeros(0)

        def done() -> list[tuple]:
            if now is None:
                return []
            if bitpix > 0:
                gone = np.isnan(data)
                if gone.any() and blank is None:
                    raise ValueError("pixels are missing and there is no BLANK")
                limits = np.iinfo(kind)
                raw = np.where(gone, 0 if blank is None else blank, np.clip(np.rint((np.where(gone, bzero, data) - bzero) / bscale), limits.min, limits.max)).astype(kind)
            else:
                raw = data.astype(kind)
            with open(f"{stem}.{now}.{TaskContext.get().taskAttemptId()}", "wb") as out:
                out.write(raw.tobytes())
            return [(now, out.name)]

        made = []
        for batch in batches:
            number, pix, value = batch.column("strip").to_numpy(), batch.column("pix").fill_null(-1).to_numpy(), batch.column("value").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)] if len(number) else []
            for a, b in zip(cuts, cuts[1:]):
                if number[a] != now:
                    made += done()
                    now = int(number[a])
                    data = np.full(min(strip, total - now * strip), np.nan)
                real = pix[a:b] >= 0
                data[pix[a:b][real] - now * strip] = value[a:b][real]
        made += done()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], ["strip", "part"])

    parts = dict(tuple(r) for r in dealt.mapInArrow(run, "strip long, part string").collect())  # a row for each strip

    def pieces():
        yield encode_header(_header(image_cards(shape, bitpix, True, bscale, bzero, blank), extra))
        for k in range(strips):
            with open(parts[k], "rb") as part:
                yield part.read()
        yield b"\0" * (-total * kind.itemsize % BLOCK)

    try:
        write_file(path, pieces())
    finally:
        for part in parts.values():
            os.unlink(part)


def rgb_pixels(frame: DataFrame, width: int, height: int) -> DataFrame:
    """Rows (x, y, r, g, b) as the pixels of a cube of three planes, for :func:`write_image` with shape [width, height, 3]."""
    planes = F.array(*[F.struct(F.lit(z).alias("z"), F.col(c).cast("double").alias("value")) for z, c in enumerate("rgb")])
    return frame.select("x", "y", F.inline(planes)).select(((F.col("z") * height + F.col("y")) * width + F.col("x")).cast("long").alias("pix"), "value")


def write_compressed(pixels: DataFrame, path: str, shape: list[int], bitpix: int, codec: str = "RICE_1", tile: list[int] | None = None, qlevel: float = 4.0, method: int = quantize.DITHER_1, seed: int = 1, blank: int | None = None, extra: Iterable[Card] = ()) -> None:
    """A file with one tile-compressed image from rows (pix, value), as :func:`write_image` takes them.

    The executors put each tile together and compress it; the tiles are a stored table, which the driver streams into
    the file partition by partition, holding only their places. Missing pixels are NaN, or ``blank`` (ZBLANK), which
    integer images then need.
    """
    tile = list(tile or [shape[0], *[1] * (len(shape) - 1)])
    counts = [-(-m // t) for m, t in zip(shape, tile)]
    total, tiles = math.prod(shape), math.prod(counts)
    number, offset, step, inner, rest = F.lit(0), F.lit(0), 1, F.lit(1), F.col("pix")
    for m, t, c in zip(shape, tile, counts):
        at, rest = rest % m, F.floor(rest / m)
        i = F.floor(at / t)
        number, step = number + i * step, step * c
        offset, inner = offset + (at - i * t) * inner, inner * F.least(F.lit(t), F.lit(m) - i * t)
    rows = pixels.filter(F.col("pix").between(0, total - 1)).select(number.cast("long").alias("tile"), offset.cast("long").alias("offset"), F.col("value").cast("double").alias("value"))
    every = pixels.sparkSession.range(tiles).select(F.col("id").alias("tile"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("double").alias("value"))
    tasks = max(1, min(tiles, 4 * int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.unionByName(every).repartition(tasks, "tile").sortWithinPartitions("tile", F.col("value").asc_nulls_first())

    def extent(n: int) -> list[int]:
        out = []
        for m, t, c in zip(shape, tile, counts):
            n, i = divmod(n, c)
            out.append(min(t, m - i * t))
        return out

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("tile", pa.int64()), ("count", pa.int64()), ("data", pa.binary()), ("fallback", pa.binary()), ("scale", pa.float64()), ("zero", pa.float64())])

        def done(n: int, data: np.ndarray) -> pa.RecordBatch:
            part = data.reshape(extent(n)[::-1])
            if bitpix > 0:
                gone = np.isnan(part)
                if gone.any() and blank is None:
                    raise ValueError("pixels are missing and there is no blank")
                part = np.where(gone, blank or 0, np.rint(part)).astype(np.int64)
            own = (n, *compress_tile(part.astype(np.float32) if bitpix == -32 else part, n, bitpix, codec, qlevel, method, seed))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(own, schema)], schema=schema)

        now, data = None, np.zeros(0)
        for batch in batches:
            place, at, value = batch.column("tile").to_numpy(), batch.column("offset").fill_null(-1).to_numpy(), batch.column("value").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)] if len(place) else []
            for a, b in zip(cuts, cuts[1:]):
                if place[a] != now:
                    if now is not None:
                        yield done(now, data)
                    now = int(place[a])
                    data = np.full(math.prod(extent(now)), np.nan)
                real = at[a:b] >= 0
                data[at[a:b][real]] = value[a:b][real]
        if now is not None:
            yield done(now, data)

    made = durable(dealt.mapInArrow(run, "tile long, count long, data binary, fallback binary, scale double, zero double"), "tiles")
    path = path.removeprefix("file://")
    spool = f"{path}.{uuid.uuid4().hex}.heap"
    places: list = [None] * tiles
    try:
        with open(spool, "wb") as heap:
            for r in made.toLocalIterator():
                at = heap.tell()
                places[r["tile"]] = (r["count"], at, len(r["fallback"]), at + len(r["data"]), r["scale"], r["zero"])
                heap.write(r["data"])
                heap.write(r["fallback"])
        size = os.path.getsize(spool)
        header, table = _tile_table(places, size, shape, tile, bitpix, codec, method, seed, blank, extra)

        def pieces():
            yield empty_primary()
            yield header
            yield table
            with open(spool, "rb") as heap:
                while part := heap.read(1 << 24):
                    yield part
            yield b"\0" * (-(len(table) + size) % BLOCK)

        write_file(path, pieces())
    finally:
        os.unlink(spool)
