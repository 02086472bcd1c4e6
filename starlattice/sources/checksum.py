"""The ones'-complement checksum of the convention."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(data: bytes, start: int = 0) -> int:
    """32-bit ones'-complement sum over big-endian words; sums of parts combine by the same addition."""
    data = data + b"\0" * (-len(data) % 4)
    total = int(np.frombuffer(data, ">u4").sum(dtype=np.uint64)) + start
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def encode(value: int, complement: bool = True) -> str:
    """Sixteen printable characters whose sum is the value (or its complement)."""
    if complement:
        value = 0xFFFFFFFF - value
    skip = {*range(0x3A, 0x41), *range(0x5B, 0x61)}
    out = [0] * 16
    for i in range(4):
        byte = value >> (24 - 8 * i) & 0xFF
        four = [byte // 4 + 0x30] * 4
        four[0] += byte % 4
        while any(c in skip for c in four):
            for a in (0, 2):
                if four[a] in skip or four[a + 1] in skip:
                    four[a] += 1
                    four[a + 1] -= 1
        for j in range(4):
            out[4 * j + i] = four[j]
    text = "".join(map(chr, out))
    return text[-1] + text[:-1]


def decode(text: str, complement: bool = True) -> int:
    text = text[1:] + text[0]
    raw = bytes(ord(c) - 0x30 for c in text)
    value = checksum(raw)
    return 0xFFFFFFFF - value if complement else value


def is_valid(unit: bytes) -> bool:
    """A whole unit that carries CHECKSUM sums to all ones (or zero)."""
    return checksum(unit) in (0, 0xFFFFFFFF)


def sums(words: DataFrame, group: list[str], word: str) -> DataFrame:
    """The ones'-complement sum (``checksum``) of 32-bit words by group: plain partial sums, folded at the end."""
    out = words.groupBy(*group).agg(F.sum(F.col(word).cast("decimal(20,0)")).alias("s"))
    for _ in range(3):
        out = out.withColumn("s", (F.col("s") % F.lit(1 << 32)) + F.floor(F.col("s") / F.lit(1 << 32)))
    return out.select(*group, F.col("s").cast("long").alias("checksum"))


def check_unit(unit: bytes, header_bytes: int, header) -> tuple[bool | None, bool | None]:
    """(data sum right, whole sum right); None where the unit carries no such card."""
    said = header.get("DATASUM")
    data = None if said is None else str(said).strip().isdigit() and int(str(said)) == checksum(unit[header_bytes:])
    return data, is_valid(unit) if "CHECKSUM" in header else None


def verify(files: DataFrame) -> DataFrame:
    """path, hdu_index, datasum_ok and checksum_ok of each unit of files from the binaryFile reader; null without the card."""
    import pyarrow as pa

    from .layout import scan

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_py()
                found = [(u.index, *check_unit(raw[u.header_start : u.padded_end], u.data_start - u.header_start, u.header)) for u in scan(io.BytesIO(raw))]
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.bool_())], ["path", "hdu_index", "datasum_ok", "checksum_ok"])

    return files.select("path", "content").mapInArrow(run, "path string, hdu_index int, datasum_ok boolean, checksum_ok boolean")
