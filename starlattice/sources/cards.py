"""Header cards: 80 columns to typed values and back."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

BLOCK, WIDTH = 2880, 80
COMMENTARY = ("COMMENT", "HISTORY", "")
MAX_BLOCKS = 1024


class FormatError(ValueError):
    """Bytes that do not follow the container's rules."""


class Truncated(FormatError):
    """The file ends inside a header or its data."""


class EmptyFile(FormatError):
    """No bytes at all."""


@dataclass(frozen=True)
class Card:
    key: str
    value: str | int | float | bool | complex | None = None
    comment: str = ""
    kind: str = "empty"  # string, logical, integer, real, complex, empty, commentary
    raw: bytes = b""  # all cards that it came from


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[EeDd][+-]?\d+)?"
_COMPLEX = re.compile(rf"\(\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\)")
_STRING = re.compile(r"'((?:[^']|'')*)'")


def _real(text: str) -> float:
    return float(text.upper().replace("D", "E"))


def parse_value(text: str) -> tuple[object, str, str]:
    """Value field to (value, kind, comment)."""
    text = text.strip()
    if text.startswith("'"):
        found = _STRING.match(text)
        if not found:
            raise FormatError(f"string without an end: {text!r}")
        value, rest = found[1].replace("''", "'").rstrip(), text[found.end() :]
        kind = "string"
    elif text.startswith("("):
        found = _COMPLEX.match(text)
        if not found:
            raise FormatError(f"not a complex number: {text!r}")
        value, rest, kind = complex(_real(found[1]), _real(found[2])), text[found.end() :], "complex"
    else:
        body, _, rest = text.partition("/")
        rest, body = "/" + rest if _ else "", body.strip()
        if not body:
            value, kind = None, "empty"
        elif body in "TF":
            value, kind = body == "T", "logical"
        elif re.fullmatch(r"[+-]?\d+", body):
            value, kind = int(body), "integer"
        elif re.fullmatch(_NUMBER, body):
            value, kind = _real(body), "real"
        else:
            raise FormatError(f"not a value: {body!r}")
    return value, kind, rest.partition("/")[2].strip()


def parse_card(raw: bytes) -> Card:
    line = raw.decode("ascii", "replace")
    if line.startswith("HIERARCH ") and "=" in line:
        key, _, text = line[9:].partition("=")
        return Card(key.strip().upper(), *_order(parse_value(text)), raw)
    key = line[:8].rstrip().upper()
    if key in COMMENTARY or line[8:10] != "= ":
        return Card(key, line[8:].rstrip(), "", "commentary", raw)
    return Card(key, *_order(parse_value(line[10:])), raw)


def _order(parsed: tuple[object, str, str]) -> tuple[object, str, str]:
    value, kind, comment = parsed
    return value, comment, kind


def split_cards(block: bytes) -> list[bytes]:
    return [block[i : i + WIDTH] for i in range(0, len(block) - WIDTH + 1, WIDTH)]


def parse_cards(raws: Iterable[bytes]) -> list[Card]:
    """Cards up to END; a string that ends in & goes on in CONTINUE cards, and its raw bytes are all of them."""
    out: list[Card] = []
    for raw in raws:
        if raw[:8] == b"END     ":
            break
        if raw[:8] == b"CONTINUE" and out and out[-1].kind == "string" and str(out[-1].value).endswith("&"):
            value, _, comment = parse_value(raw[8:].decode("ascii", "replace"))
            last = out[-1]
            out[-1] = replace(last, value=str(last.value)[:-1] + str(value or ""), comment=" ".join(c for c in (last.comment, comment) if c), raw=last.raw + raw)
            continue
        out.append(parse_card(raw))
    return out


class Header:
    """Cards in order; keys are found whatever their case, the first of several wins."""

    def __init__(self, cards: Iterable[Card] = ()):
        self.cards = list(cards)

    def _index(self, key: str) -> int:
        key = key.upper()
        return next((i for i, c in enumerate(self.cards) if c.key == key), -1)

    def __contains__(self, key: str) -> bool:
        return self._index(key) >= 0

    def get(self, key: str, default=None):
        at = self._index(key)
        return default if at < 0 or self.cards[at].value is None else self.cards[at].value

    def typed(self, key: str, kind: type):
        """The value if it has the type (an integer also counts as float), else TypeError; KeyError if there is none."""
        if key not in self:
            raise KeyError(key)
        value = self.get(key)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            return float(value)
        if type(value) is not kind:
            raise TypeError(f"{key} is {type(value).__name__}, not {kind.__name__}")
        return value

    def set(self, key: str, value, comment: str = "") -> Header:
        card = make_card(key, value, comment)
        at = self._index(key)
        cards = list(self.cards)
        if at < 0:
            cards.append(card)
        else:
            cards[at] = card
        return Header(cards)

    def add(self, card: Card) -> Header:
        return Header([*self.cards, card])

    def delete(self, key: str) -> Header:
        return Header(c for c in self.cards if c.key != key.upper())

    def texts(self, key: str) -> list[str]:
        """All lines of COMMENT or HISTORY."""
        return [str(c.value) for c in self.cards if c.key == key.upper()]

    def values(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for c in self.cards:
            if c.kind != "commentary" and c.value is not None:
                out.setdefault(c.key, c.value)
        return out


def make_card(key: str, value, comment: str = "") -> Card:
    kinds = {bool: "logical", int: "integer", float: "real", complex: "complex", str: "string", type(None): "empty"}
    kind = "commentary" if key.upper() in COMMENTARY else kinds[type(value)]
    return Card(key.upper(), value, comment, kind)


def _number(value: float) -> str:
    text = repr(float(value)).upper()
    return text if any(c in text for c in ".EN") else text + "."


def _text_of(card: Card) -> str:
    v = card.value
    if card.kind == "logical":
        return f"{'T' if v else 'F':>20}"
    if card.kind == "integer":
        return f"{v:>20}"
    if card.kind == "real":
        return f"{_number(v):>20}"
    if card.kind == "complex":
        return f"({_number(v.real)}, {_number(v.imag)})"
    if card.kind == "string":
        return "'" + f"{v.replace(chr(39), chr(39) * 2):<8}" + "'"
    return ""


def encode_card(card: Card) -> bytes:
    """One card or, for a long string, a card and its CONTINUE cards. Cards that were read come out as they were."""
    if card.raw:
        return card.raw
    if card.kind == "commentary":
        text = str(card.value or "")
        parts = [text[i : i + 72] for i in range(0, len(text), 72)] or [""]
        return b"".join(f"{card.key:<8}{p:<72}".encode("ascii", "replace") for p in parts)
    plain = len(card.key) <= 8 and re.fullmatch(r"[A-Z0-9_-]+", card.key)
    start = f"{card.key:<8}= " if plain else f"HIERARCH {card.key} = "
    body = _text_of(card)
    line = start + body
    if len(line) <= WIDTH:
        if card.comment and len(line) + 3 < WIDTH:
            line += f" / {card.comment}"
        return f"{line[:WIDTH]:<{WIDTH}}".encode("ascii", "replace")
    if card.kind != "string":
        raise FormatError(f"{card.key} does not fit a card")
    room = WIDTH - len(start) - 3
    inner = str(card.value).replace("'", "''")
    parts = []
    while len(inner) > room:
        cut = room - 1 if inner[:room].count("'") % 2 or inner[room - 1] == "'" else room
        while inner[:cut].endswith("'") and (len(inner[:cut]) - len(inner[:cut].rstrip("'"))) % 2:
            cut -= 1
        parts.append(inner[:cut])
        inner, room = inner[cut:], WIDTH - 13
    parts.append(inner)
    lines = [f"{start}'{parts[0]}&'"] + [f"CONTINUE  '{p}&'" for p in parts[1:-1]] + [f"CONTINUE  '{parts[-1]}'"]
    return b"".join(f"{line:<{WIDTH}}".encode("ascii", "replace") for line in lines)


def encode_header(header: Header) -> bytes:
    data = b"".join(encode_card(c) for c in header.cards) + b"END".ljust(WIDTH)
    return data.ljust(-(-len(data) // BLOCK) * BLOCK)
