"""Command line: ``python -m starlattice.tools dump FILE`` and ``copy FROM TO``."""

from __future__ import annotations

import sys

from .sources.layout import scan
from .sources.writer import unit_bytes, write_file


def dump(path: str) -> list[str]:
    """A line for each unit and each of its cards."""
    with open(path, "rb") as file:
        units = scan(file)
    out = []
    for u in units:
        out.append(f"unit {u.index} {u.kind} {u.name} {u.shape} data {u.data_start}..{u.data_end}")
        out += [f"  {c.key:<8} {c.value!r} {c.comment}".rstrip() for c in u.header.cards]
    return out


def copy(source: str, target: str) -> None:
    """All units byte by byte."""
    with open(source, "rb") as file:
        units = scan(file)
    write_file(target, (unit_bytes(source, u) for u in units))


def main(args: list[str]) -> int:
    if len(args) == 2 and args[0] == "dump":
        print("\n".join(dump(args[1])))
    elif len(args) == 3 and args[0] == "copy":
        copy(args[1], args[2])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
