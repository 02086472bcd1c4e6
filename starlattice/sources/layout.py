"""Where things are in a file: header-data units, their kinds and sizes; table columns and their byte layout."""

from __future__ import annotations

import io
import re
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from .cards import BLOCK, MAX_BLOCKS, EmptyFile, FormatError, Header, Truncated, parse_cards, split_cards

BITPIX = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: TFORM letter -> bytes of an element and numpy type.
ELEMENTS = {"L": (1, "u1"), "X": (0, "u1"), "B": (1, "u1"), "I": (2, ">i2"), "J": (4, ">i4"), "K": (8, ">i8"), "A": (1, "S1"), "E": (4, ">f4"), "D": (8, ">f8"), "C": (8, ">c8"), "M": (16, ">c16"), "P": (8, ">i4"), "Q": (16, ">i8")}


@dataclass
class Hdu:
    index: int
    kind: str
    header: Header
    header_start: int
    data_start: int
    data_end: int
    padded_end: int

    @property
    def shape(self) -> list[int]:
        return [int(self.header.get(f"NAXIS{i + 1}", 0)) for i in range(int(self.header.get("NAXIS", 0)))]

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", ""))


def classify(header: Header, index: int) -> str:
    if index == 0:
        return "random_groups" if header.get("GROUPS") is True and header.get("NAXIS1") == 0 and header.get("NAXIS", 0) > 0 else "primary"
    kind = str(header.get("XTENSION", "")).strip()
    if kind in ("BINTABLE", "A3DTABLE"):
        return "compressed" if header.get("ZIMAGE") is True else "bintable"
    return {"IMAGE": "image", "TABLE": "ascii_table"}.get(kind, "unknown")


def data_size(header: Header) -> int:
    axes = [int(header.get(f"NAXIS{i + 1}", 0)) for i in range(int(header.get("NAXIS", 0)))]
    if not axes:
        return 0
    if header.get("GROUPS") is True and axes[0] == 0:
        axes = axes[1:]
    return abs(int(header.get("BITPIX"))) // 8 * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + int(np.prod(axes, dtype=object)))


def validate(header: Header, index: int) -> None:
    first = "SIMPLE" if index == 0 else "XTENSION"
    if not header.cards or header.cards[0].key != first:
        raise FormatError(f"unit {index} does not begin with {first}")
    if header.get("BITPIX") not in BITPIX:
        raise FormatError(f"unit {index} has BITPIX {header.get('BITPIX')}")
    n = header.get("NAXIS")
    if not isinstance(n, int) or not 0 <= n <= 999:
        raise FormatError(f"unit {index} has NAXIS {n}")
    for i in range(n):
        if not isinstance(header.get(f"NAXIS{i + 1}"), int) or header.get(f"NAXIS{i + 1}") < 0:
            raise FormatError(f"unit {index} lacks NAXIS{i + 1}")
    for key, least in (("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 0)):
        value = header.get(key, least)
        if not isinstance(value, int) or value < least or key == "TFIELDS" and value > 999:
            raise FormatError(f"unit {index} has {key} {value}")


def read_unit(file: BinaryIO, at: int, index: int, size: int | None = None) -> Hdu | None:
    """The unit whose header begins at a byte; None if only padding is left."""
    size = file.seek(0, io.SEEK_END) if size is None else size
    file.seek(at)
    raw = b""
    for _ in range(MAX_BLOCKS):
        block = file.read(BLOCK)
        if len(block) < BLOCK:
            if index and not raw.strip(b"\0 ") and not block.strip(b"\0 "):
                return None
            raise Truncated(f"unit {index}: the header has no END")
        raw += block
        if any(c[:8] == b"END     " for c in split_cards(block)):
            break
    else:
        raise FormatError(f"unit {index}: more than {MAX_BLOCKS} header blocks")
    header = Header(parse_cards(split_cards(raw)))
    validate(header, index)
    start = at + len(raw)
    end = start + data_size(header)
    if end > size:
        raise Truncated(f"unit {index}: the data end at {end}, the file at {size}")
    return Hdu(index, classify(header, index), header, at, start, end, start + -(-(end - start) // BLOCK) * BLOCK)


def scan(file: BinaryIO) -> list[Hdu]:
    """All units, by seeking from header to header; pixels and rows are not read."""
    size = file.seek(0, io.SEEK_END)
    if size == 0:
        raise EmptyFile("the file is empty")
    out, at = [], 0
    while at < size:
        unit = read_unit(file, at, len(out), size)
        if unit is None:
            break
        out.append(unit)
        at = unit.padded_end
    return out


@dataclass
class Column:
    name: str
    code: str
    repeat: int
    offset: int
    width: int
    scale: float = 1.0
    zero: float = 0.0
    null: int | None = None
    unit: str = ""
    dim: tuple[int, ...] = ()
    inner: str = ""  # element code of a ragged column
    display: str = ""


def parse_tform(text: str) -> tuple[int, str, str]:
    """'3E' -> (3, 'E', ''); '1PB(17)' -> (1, 'P', 'B')."""
    found = re.fullmatch(r"\s*(\d*)([LXBIJKAEDCMPQ])([LXBIJKAEDCM]?)(.*)", text.strip())
    if not found:
        raise FormatError(f"bad TFORM {text!r}")
    return int(found[1] or 1), found[2], found[3] if found[2] in "PQ" else ""


def parse_tdim(text: str) -> tuple[int, ...]:
    found = re.fullmatch(r"\(\s*\d+(?:\s*,\s*\d+)*\s*\)", text.strip())
    if not found:
        raise FormatError(f"bad TDIM {text!r}")
    return tuple(int(t) for t in text.strip()[1:-1].split(","))


def columns(header: Header) -> list[Column]:
    """Columns of a binary table; their widths must add up to NAXIS1."""
    out, at = [], 0
    for i in range(1, int(header.get("TFIELDS", 0)) + 1):
        repeat, code, inner = parse_tform(str(header.get(f"TFORM{i}", "")))
        width = -(-repeat // 8) if code == "X" else repeat * ELEMENTS[code][0]
        dim = header.get(f"TDIM{i}")
        out.append(Column(str(header.get(f"TTYPE{i}", f"col{i}")).strip(), code, repeat, at, width, float(header.get(f"TSCAL{i}", 1)), float(header.get(f"TZERO{i}", 0)), header.get(f"TNULL{i}"), str(header.get(f"TUNIT{i}", "")), parse_tdim(str(dim)) if dim else (), inner, str(header.get(f"TDISP{i}", ""))))
        at += width
    if at != int(header.get("NAXIS1", 0)):
        raise FormatError(f"columns take {at} bytes, rows have {header.get('NAXIS1')}")
    return out


def heap_start(hdu: Hdu) -> int:
    return hdu.data_start + int(hdu.header.get("THEAP", hdu.shape[0] * hdu.shape[1]))


def ascii_columns(header: Header) -> list[Column]:
    """Columns of a text table: code A, I or F (for F, E and D), offset and width in characters."""
    out = []
    for i in range(1, int(header.get("TFIELDS", 0)) + 1):
        found = re.fullmatch(r"\s*([AIFED])(\d+)(?:\.\d+)?\s*", str(header.get(f"TFORM{i}", "")))
        if not found:
            raise FormatError(f"bad TFORM{i}")
        out.append(Column(str(header.get(f"TTYPE{i}", f"col{i}")).strip(), {"A": "A", "I": "I"}.get(found[1], "F"), 1, int(header.get(f"TBCOL{i}", 1)) - 1, int(found[2]), float(header.get(f"TSCAL{i}", 1)), float(header.get(f"TZERO{i}", 0)), header.get(f"TNULL{i}"), str(header.get(f"TUNIT{i}", ""))))
    return out


def physical(raw: np.ndarray, scale: float, zero: float, null: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """raw * scale + zero, exact where that is a whole-number shift; and where values are missing."""
    missing = np.isnan(raw) if raw.dtype.kind == "f" else (raw == null) if null is not None else None
    native = raw.astype(raw.dtype.newbyteorder("="), copy=False)
    if scale == 1 and zero == 0:
        return native, missing
    if native.dtype.kind in "iu" and scale == 1 and float(zero).is_integer():
        if native.itemsize < 8:
            return native.astype(np.int64) + int(zero), missing
        return native.astype(object) + int(zero) if abs(zero) >= 2**63 else native + np.int64(zero), missing
    return native.astype(np.float64) * scale + zero, missing
