"""The path language: ``user:1.friends[?age > 30 and active = true]{name, posts{title}}``.

A query is an entity followed by hops (``.p``, ``<- p``), filters, one expansion and
recursions (``*`` or ``*[depth <= n]``).  Errors carry line and column.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

MAX_NESTING = 50
MAX_DEPTH, DEFAULT_DEPTH = 100, 10


class PathSyntaxError(ValueError):
    def __init__(self, message: str, text: str, at: int):
        line, column = text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Logic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Field:
    name: str
    nested: tuple[Field, ...] = ()


@dataclass(frozen=True)
class Entity:
    namespace: str
    id: str


@dataclass(frozen=True)
class Hop:
    source: object
    predicate: str
    reverse: bool = False


@dataclass(frozen=True)
class Filter:
    source: object
    condition: object


@dataclass(frozen=True)
class Expand:
    source: object
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Recurse:
    source: object
    depth: int
    exact: bool = False


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


_TOKEN = re.compile(r"""(?P<space>\s+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_$][\w$-]*)|(?P<op><-|<=|>=|!=|=|<|>)|(?P<mark>[:.,?*(){}\[\]-])""")


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PathSyntaxError(f"unexpected character {text[at]!r}", text, at)
        if m.lastgroup != "space":
            kind = m.lastgroup or ""
            out.append(Token(m.group() if kind in ("op", "mark") else kind, m.group(), at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i, self.depth = text, tokenize(text), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, message: str) -> PathSyntaxError:
        return PathSyntaxError(message, self.text, self.now.at)

    def take(self, *kinds: str) -> Token:
        if self.now.kind not in kinds:
            raise self.fail(f"expected {' or '.join(kinds)}, found {self.now.text or 'the end'!r}")
        self.i += 1
        return self.tokens[self.i - 1]

    def met(self, kind: str) -> bool:
        if self.now.kind == kind:
            self.i += 1
            return True
        return False

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MAX_NESTING:
            raise self.fail(f"nested deeper than {MAX_NESTING}")

    def query(self) -> object:
        node: object = self.entity()
        while self.now.kind != "end":
            if self.met("."):
                node = Hop(node, self.take("name").text)
            elif self.met("<-"):
                node = Hop(node, self.take("name").text, True)
            elif self.met("["):
                self.take("?")
                node = Filter(node, self.any_of())
                self.take("]")
            elif self.met("{"):
                node = Expand(node, self.fields())
            elif self.now.kind == "*":
                if not _follows_hop(node):
                    raise self.fail("a recursion repeats a hop, and there is none before it")
                self.i += 1
                node = self.recursion(node)
            else:
                raise self.fail(f"unexpected {self.now.text!r}")
        return node

    def entity(self) -> Entity:
        namespace = self.take("name").text
        self.take(":")
        t = self.take("name", "number", "string")
        return Entity(namespace, _unquoted(t.text) if t.kind == "string" else t.text)

    def recursion(self, node: object) -> Recurse:
        if self.now.kind != "[" or self.tokens[self.i + 1].text.lower() != "depth":
            return Recurse(node, DEFAULT_DEPTH)
        self.i += 2
        op = self.take("<=", "<", "=").kind
        n = int(self.take("number").text) - (op == "<")
        self.take("]")
        return Recurse(node, min(n, MAX_DEPTH), op == "=")

    def fields(self) -> tuple[Field, ...]:
        self.deeper()
        out = []
        while not self.met("}"):
            name = self.take("name").text
            out.append(Field(name, self.fields() if self.met("{") else ()))
            self.met(",")
        self.depth -= 1
        if not out:
            raise self.fail("an expansion names at least one field")
        return tuple(out)

    def any_of(self) -> object:
        node = self.all_of()
        while self.now.kind == "name" and self.now.text.lower() == "or":
            self.i += 1
            node = Logic("or", node, self.all_of())
        return node

    def all_of(self) -> object:
        node = self.term()
        while self.now.kind == "name" and self.now.text.lower() == "and":
            self.i += 1
            node = Logic("and", node, self.term())
        return node

    def term(self) -> object:
        if self.met("("):
            self.deeper()
            node = self.any_of()
            self.take(")")
            self.depth -= 1
            return node
        name = self.take("name").text
        return Compare(name, self.take("=", "!=", "<", ">", "<=", ">=").kind, self.value())

    def value(self) -> object:
        sign = -1 if self.met("-") else 1
        t = self.take("number") if sign < 0 else self.take("number", "string", "name")
        if t.kind == "number":
            return sign * (float(t.text) if "." in t.text else int(t.text))
        if t.kind == "string":
            return _unquoted(t.text)
        return {"true": True, "false": False}.get(t.text.lower(), t.text)


def _follows_hop(node: object) -> bool:
    while isinstance(node, (Filter, Recurse)):
        node = node.source
    return isinstance(node, Hop)


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


@lru_cache(maxsize=1000)
def parse(text: str) -> object:
    return _Parser(text).query()


def _value_text(value: object) -> str:
    return json.dumps(value)


def _condition_text(c: object) -> str:
    if isinstance(c, Compare):
        return f"{c.field} {c.op} {_value_text(c.value)}"
    return f"({_condition_text(c.left)} {c.op} {_condition_text(c.right)})"


def _fields_text(fields: tuple[Field, ...]) -> str:
    return " {" + ", ".join(f.name + (_fields_text(f.nested) if f.nested else "") for f in fields) + "}"


def stringify(node: object) -> str:
    """Text that parses to ``node``; ids are quoted where they must be."""
    if isinstance(node, Entity):
        plain = re.fullmatch(r"\d+|[A-Za-z_$][\w$-]*", node.id)
        return f"{node.namespace}:{node.id if plain else json.dumps(node.id)}"
    before = stringify(node.source)
    if isinstance(node, Hop):
        return f"{before} <- {node.predicate}" if node.reverse else f"{before}.{node.predicate}"
    if isinstance(node, Filter):
        return f"{before}[?{_condition_text(node.condition)}]"
    if isinstance(node, Expand):
        return before + _fields_text(node.fields)
    return f"{before}*[depth {'=' if node.exact else '<='} {node.depth}]"


def count_hops(node: object) -> int:
    if isinstance(node, Entity):
        return 0
    own = 1 if isinstance(node, Hop) else node.depth - 1 if isinstance(node, Recurse) else 0
    return own + count_hops(node.source)
