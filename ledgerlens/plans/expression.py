"""The entity query language: text to tokens, to a tree, to a Column.

Attested: * and $all; $contentType = "text"; $owner = 0xaddress; $expiration < number; name = "text". Extensions, which
are marked so in the code: other comparisons, numbers and entity keys as attribute values, $key, and, or, not, brackets.
Values become literals of Columns; no SQL text is put together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: System fields: the column, and the kind of value. Fixed values, but for $key, an extension.
FIELDS = {"$contentType": ("contentType", "string"), "$owner": ("owner", "hex"), "$expiration": ("expiresAt", "number"), "$key": ("key", "hex")}
TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<hex>0x[0-9a-fA-F]+)|(?P<number>[0-9]+)|(?P<op><=|>=|!=|=|<|>|&&|\|\||!|\(|\)|\*)|(?P<name>\$?[A-Za-z_][A-Za-z0-9_.-]*))""")
OPERATORS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
EXTENDED = {"and": "&&", "or": "||", "not": "!"}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    kind: str
    value: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Join:
    op: str
    left: object
    right: object


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read {text[at:at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "name" and value.lower() in EXTENDED:
            kind, value = "op", EXTENDED[value.lower()]
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    """or < and < not < comparison; brackets group."""

    def __init__(self, text: str):
        self.rest = tokens(text)[::-1]

    def peek(self) -> tuple[str, str]:
        return self.rest[-1] if self.rest else ("end", "")

    def take(self) -> tuple[str, str]:
        if not self.rest:
            raise QueryError("unexpected end")
        return self.rest.pop()

    def parse(self):
        tree = self.chain("||", lambda: self.chain("&&", self.factor))
        if self.rest:
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return tree

    def chain(self, op, part):  # extension
        tree = part()
        while self.peek() == ("op", op):
            self.take()
            tree = Join(op, tree, part())
        return tree

    def factor(self):
        kind, value = self.take()
        if (kind, value) == ("op", "!"):  # extension
            return Not(self.factor())
        if (kind, value) == ("op", "("):  # extension
            tree = self.chain("||", lambda: self.chain("&&", self.factor))
            if self.take() != ("op", ")"):
                raise QueryError("expected )")
            return tree
        if (kind, value) in (("op", "*"), ("name", "$all")):
            return All()
        if kind != "name":
            raise QueryError(f"expected a field, got {value!r}")
        op, (what, literal) = self.take(), self.take()
        if op[0] != "op" or op[1] not in OPERATORS or what not in ("string", "hex", "number"):
            raise QueryError(f"expected a comparison of {value}")
        if value.startswith("$") and value not in FIELDS:
            raise QueryError(f"unknown field {value}")
        if value in FIELDS and FIELDS[value][1] != what:
            raise QueryError(f"{value} needs a {FIELDS[value][1]}")
        if what == "string":
            literal = re.sub(r"\\(.)", r"\1", literal[1:-1])
        return Compare(value, op[1], what, literal.removeprefix("0x").lower() if what == "hex" else literal)


def parse(text: str):
    return _Parser(text).parse()


def to_column(tree) -> Column:
    """A condition on entities (key, owner, contentType, expiresAt, attributes); null nowhere."""
    if isinstance(tree, All):
        return F.lit(True)
    if isinstance(tree, Not):
        return ~to_column(tree.of)
    if isinstance(tree, Join):
        a, b = to_column(tree.left), to_column(tree.right)
        return a & b if tree.op == "&&" else a | b
    value = F.lit(int(tree.value)) if tree.kind == "number" else F.lit(tree.value)
    if tree.field in FIELDS:
        return F.coalesce(getattr(F.col(FIELDS[tree.field][0]), OPERATORS[tree.op])(value), F.lit(False))
    kind = {"string": "string", "hex": "entityKey", "number": "uint"}[tree.kind]

    def holds(a):
        have = a["value"].try_cast("decimal(38,0)") if kind == "uint" else a["value"]
        return (a["name"] == tree.field) & (a["valueType"] == kind) & getattr(have, OPERATORS[tree.op])(value)

    return F.coalesce(F.exists("attributes", holds), F.lit(False))


def compile_query(text: str) -> Column:
    return to_column(parse(text))
