"""Attribute lists, weights and references as they are typed on a command line. Plain Python: such inputs are short."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import codecs

#: Names of attribute types and what they stand for. Fixed values.
TYPES = {"string": "string", "str": "string", "uint": "uint", "u256": "uint", "entityKey": "entityKey", "entity-key": "entityKey", "key": "entityKey"}
#: Characters that may follow a backslash in quotes. Fixed values.
ESCAPES = {"\\": "\\", "'": "'", '"': '"', ",": ",", "n": "\n", "r": "\r", "t": "\t"}
KEY = re.compile(r"0x[0-9a-fA-F]{64}")
NUMBER = re.compile(r"[0-9]+|0x[0-9a-fA-F]+|0o[0-7]+|0b[01]+")


class ShorthandError(ValueError):
    pass


@dataclass(frozen=True)
class Attribute:
    name: str
    value_type: str
    value: str


def split_parts(text: str) -> list[str]:
    """Parts between commas that stand outside quotes; a backslash counts inside quotes only."""
    parts, start, quote, k = [], 0, "", 0
    while k < len(text):
        c = text[k]
        if quote and c == "\\":
            k += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ",":
            parts.append(text[start:k])
            start = k + 1
        k += 1
    if quote:
        raise ShorthandError("unterminated quote")
    parts.append(text[start:])
    if any(not p.strip() for p in parts):
        raise ShorthandError("empty attribute")
    return [p.strip() for p in parts]


def unquote(text: str) -> str:
    """The inside of a quoted text, its escapes resolved; a quote alone is no quoted text."""
    if len(text) < 2 or text[0] not in "'\"" or text[-1] != text[0]:
        raise ShorthandError("bad quotes")

    def one(m: re.Match) -> str:
        if m[1] not in ESCAPES:
            raise ShorthandError(f"unknown escape \\{m[1]}")
        return ESCAPES[m[1]]

    inside = text[1:-1]
    if text[0] in inside and "\\" not in inside:
        raise ShorthandError("a quote inside quotes needs a backslash")
    return re.sub(r"\\(.|$)", one, inside, flags=re.S)


def number_of(text: str) -> str:
    """A whole number below 2 to the 256, in decimal: decimal digits, or 0x, 0o or 0b and theirs."""
    found = int(text, 0) if text[:2] in ("0x", "0o", "0b") else int(text)
    if found >> 256:
        raise ShorthandError("bad uint")
    return str(found)


def parse_attribute(part: str) -> Attribute:
    """name=value or name:type=value; the first = divides, and of what stands before it the last colon. Space around the
    three parts doesn't count."""
    left, equals, value = (x.strip() for x in part.partition("="))
    if not equals or not left or not value:
        raise ShorthandError("expected name=value")
    name, colon, kind = (x.strip() for x in left.rpartition(":"))
    if not colon:
        name, kind = left, None
    if not re.fullmatch(r"[a-z][a-z0-9._-]{0,31}", name):
        raise ShorthandError(f"bad name {name!r}")
    quoted = value[0] in "'\""
    if kind is None:
        kind = "string" if quoted else "entityKey" if KEY.fullmatch(value) else "uint"
        if kind == "uint" and not NUMBER.fullmatch(value):
            raise ShorthandError("not a number; quote it to make it a string")
    elif kind not in TYPES:
        raise ShorthandError(f"unknown type {kind!r}")
    kind = TYPES[kind]
    value = unquote(value) if quoted else value
    if kind == "uint" and not NUMBER.fullmatch(value) or kind == "entityKey" and not KEY.fullmatch(value):
        raise ShorthandError(f"bad {kind}")
    value = number_of(value) if kind == "uint" else value
    if kind == "string" and len(value.encode()) > codecs.STRING_BYTES:
        raise ShorthandError("string too long")
    return Attribute(name, kind, value)


def parse_attributes(text: str) -> list[Attribute]:
    """Ascending by name; a name twice is an error."""
    found = sorted((parse_attribute(p) for p in split_parts(text)), key=lambda a: a.name) if text else []
    if len({a.name for a in found}) < len(found):
        raise ShorthandError("name given twice")
    return found


def parse_weights(text: str) -> list[tuple[str, int]]:
    """(operation, weight) pairs in the order given; expire can't be weighed, and not all may be zero."""
    found = []
    for part in text.split(","):
        name, equals, number = part.strip().partition("=")
        if not equals or name not in codecs.OPERATIONS[:5] or not re.fullmatch("[0-9]+", number):
            raise ShorthandError(f"bad weight {part!r}")
        found.append((name, int(number)))
    if not sum(w for _, w in found):
        raise ShorthandError("all weights are zero")
    return found


def parse_reference(text: str) -> int | bytes:
    """$N is the N-th operation of the batch, else 0x and 64 hex digits are a key."""
    if re.fullmatch(r"\$[0-9]+", text):
        return int(text[1:])
    if KEY.fullmatch(text):
        return bytes.fromhex(text[2:])
    raise ShorthandError(f"bad entity key {text!r}")
