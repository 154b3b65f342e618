"""A small sandboxed template language, compiled: text to syntax tree, constants folded, tree to Python closures.

    {{ expression }}   {% set name = expression %}   {# comment #}
    {% if a %} .. {% elif b %} .. {% else %} .. {% endif %}
    {% for name in expression %} .. {% endfor %}           (inside: loop.index, loop.first, loop.last)
    {% generation %} .. {% endgeneration %}                (marks what a model is trained to write)

Expressions: strings, whole numbers, true, false, none, names, `a.b`, `a[b]`, `| filter`, not, and, or, ==, !=, <, <=,
>, >=, in, +, -, ~ (join as text), `x if c else y`. Sandboxed: a dot or an index only looks a key up in a mapping or a
place up in a list; there are no calls, no Python attributes and no other names than those given. What is missing is
none, and none prints as nothing.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

Env = dict
Expression = Callable[[Env], object]


class TemplateError(ValueError):
    pass


# ---- syntax tree ----

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Lookup:
    of: object
    key: object


@dataclass(frozen=True)
class Unary:
    op: str
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class Set:
    name: str
    of: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- filters: escapes can be undone ----

def escape(text: str) -> str:
    """No `#` and no `</` is left bare, so no control string can appear; `unescape` gives the text back."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def escape_line(text: str) -> str:
    """As escape, and line feeds do not end the line."""
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def as_text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(as_text(v)), "escape_line": lambda v: escape_line(as_text(v)),
    "trim": lambda v: as_text(v).strip(), "upper": lambda v: as_text(v).upper(), "lower": lambda v: as_text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, Mapping)) else 0,
}

# ---- parser ----

_PARTS = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<op>==|!=|<=|>=|[<>+\-~|.()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_COMPARE = ("==", "!=", "<", "<=", ">", ">=", "in")


class _Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"unexpected {source[at:at + 10]!r} in {source!r}")
            self.tokens.append((match.lastgroup, match.group(match.lastgroup)))
            at = match.end()
        self.at, self.source = 0, source

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.next_is(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing in {self.source!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a name is missing in {self.source!r}")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")

    def expression(self):
        value = self.any_of(0)
        if self.take("if"):
            test = self.any_of(0)
            self.need("else")
            return Choice(test, value, self.expression())
        return value

    _LEVELS = (("or",), ("and",), ("not",), _COMPARE, ("+", "-", "~"))

    def any_of(self, level: int):
        if level == len(self._LEVELS):
            return self.filtered()
        if level == 2:
            return Unary("not", self.any_of(2)) if self.take("not") else self.any_of(3)
        value = self.any_of(level + 1)
        while op := self.take(*self._LEVELS[level]):
            value = Binary(op, value, self.any_of(level + 1))
        return value

    def filtered(self):
        value = self.primary()
        while True:
            if self.take("."):
                value = Lookup(value, Const(self.name()))
            elif self.take("["):
                value = Lookup(value, self.expression())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = Filter(name, value)
            else:
                return value

    def primary(self):
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(int(text))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            return Const(_WORDS[text]) if text in _WORDS else Name(text)
        raise TemplateError(f"unexpected {text!r} in {self.source!r}")


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for match in _PARTS.finditer(source):
        text = source[at : match.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if match[0][2:3] == "-" else text))
        if match[1] is not None or match[2] is not None:
            parts.append(("output", match[1]) if match[1] is not None else ("tag", match[2]))
        at, trim = match.end(), match[0][-3:-2] == "-"
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    parts.reverse()
    body, end = _body(parts)
    if end:
        raise TemplateError(f"{end!r} without a beginning")
    return body


def _body(parts: list[tuple[str, str]]) -> tuple[tuple, str]:
    """Nodes up to the tag that ends this body, and that tag."""
    nodes: list = []
    while parts:
        kind, text = parts.pop()
        if kind == "text":
            nodes.append(Text(text))
            continue
        line = _Parser(text)
        if kind == "output":
            nodes.append(Output(line.expression()))
        elif line.take("set"):
            name = line.name()
            line.need("=")
            nodes.append(Set(name, line.expression()))
        elif line.take("for"):
            name = line.name()
            line.need("in")
            of = line.expression()
            body, end = _body(parts)
            _expect(end, "endfor")
            nodes.append(For(name, of, body))
        elif line.take("if"):
            nodes.append(_if(line.expression(), parts))
        elif line.take("generation"):
            body, end = _body(parts)
            _expect(end, "endgeneration")
            nodes.append(Generation(body))
        else:
            return tuple(nodes), text.strip()
        line.end()
    return tuple(nodes), ""


def _if(test, parts) -> If:
    yes, end = _body(parts)
    if end.startswith("elif"):
        line = _Parser(end)
        line.need("elif")
        return If(test, yes, (_if(line.expression(), parts),))
    no: tuple = ()
    if end == "else":
        no, end = _body(parts)
    _expect(end, "endif")
    return If(test, yes, no)


def _expect(found: str, wanted: str) -> None:
    if found != wanted:
        raise TemplateError(f"{wanted!r} is missing, found {found!r}")


# ---- constant folding ----

_NUMBERS = (int, float)


def _plus(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


def _minus(a, b):
    if isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        return a - b
    raise TemplateError("- takes two numbers")


_BINARY = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
           "in": lambda a, b: b is not None and a in b, "+": _plus, "-": _minus, "~": lambda a, b: as_text(a) + as_text(b)}


def fold(node):
    """The same tree with all that is constant worked out."""
    if isinstance(node, tuple):
        nodes: list = []
        for child in map(fold, node):
            for part in child if isinstance(child, tuple) else (child,):
                if isinstance(part, Text) and nodes and isinstance(nodes[-1], Text):
                    nodes[-1] = Text(nodes[-1].value + part.value)
                elif not (isinstance(part, Text) and not part.value):
                    nodes.append(part)
        return tuple(nodes)
    if isinstance(node, Lookup):
        return Lookup(fold(node.of), fold(node.key))
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Unary):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Unary(node.op, of)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if node.op in ("and", "or"):
            if isinstance(left, Const):
                return right if bool(left.value) == (node.op == "and") else left
        elif isinstance(left, Const) and isinstance(right, Const):
            return Const(_BINARY[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Choice):
        test, yes, no = fold(node.test), fold(node.yes), fold(node.no)
        return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
    if isinstance(node, Output):
        of = fold(node.of)
        return Text(as_text(of.value)) if isinstance(of, Const) else Output(of)
    if isinstance(node, Set):
        return Set(node.name, fold(node.of))
    if isinstance(node, If):
        test, yes, no = fold(node.test), fold(node.yes), fold(node.no)
        return (yes if test.value else no) if isinstance(test, Const) else If(test, yes, no)
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


# ---- closures ----

def _expression(node) -> Expression:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Lookup):
        of, key = _expression(node.of), _expression(node.key)

        def lookup(env):
            value, k = of(env), key(env)
            if isinstance(value, Mapping):
                return value.get(k)
            if isinstance(value, (list, tuple)) and isinstance(k, int) and -len(value) <= k < len(value):
                return value[k]
            return None
        return lookup
    if isinstance(node, Filter):
        function, of = FILTERS[node.name], _expression(node.of)
        return lambda env: function(of(env))
    if isinstance(node, Unary):
        of = _expression(node.of)
        return lambda env: not of(env)
    if isinstance(node, Choice):
        test, yes, no = map(_expression, (node.test, node.yes, node.no))
        return lambda env: yes(env) if test(env) else no(env)
    left, right = _expression(node.left), _expression(node.right)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    function = _BINARY[node.op]
    return lambda env: function(left(env), right(env))


class _Sink:
    """Rendered pieces, and the ranges of code points under a generation marker."""

    def __init__(self):
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _statements(nodes: tuple) -> Callable[[Env, _Sink], None]:
    steps = [_statement(n) for n in nodes]

    def run(env: Env, sink: _Sink) -> None:
        for step in steps:
            step(env, sink)
    return steps[0] if len(steps) == 1 else run


def _statement(node) -> Callable[[Env, _Sink], None]:
    if isinstance(node, Text):
        value = node.value
        return lambda env, sink: sink.write(value)
    if isinstance(node, Output):
        of = _expression(node.of)
        return lambda env, sink: sink.write(as_text(of(env)))
    if isinstance(node, Set):
        name, of = node.name, _expression(node.of)
        return lambda env, sink: env.__setitem__(name, of(env))
    if isinstance(node, If):
        test, yes, no = _expression(node.test), _statements(node.yes), _statements(node.no)
        return lambda env, sink: yes(env, sink) if test(env) else no(env, sink)
    if isinstance(node, For):
        name, of, body = node.name, _expression(node.of), _statements(node.body)

        def loop(env: Env, sink: _Sink) -> None:
            items = of(env) or ()
            inner = dict(env)
            for i, item in enumerate(items):
                inner[name] = item
                inner["loop"] = {"index": i + 1, "first": i == 0, "last": i + 1 == len(items)}
                body(inner, sink)
        return loop
    body = _statements(node.body)

    def generation(env: Env, sink: _Sink) -> None:
        start = sink.size
        body(env, sink)
        sink.spans.append((start, sink.size))
    return generation


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _statements(self.tree)

    def render(self, **values) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the ranges of it (start, end in code points) that a model is trained to write."""
        sink = _Sink()
        self._run(dict(values), sink)
        return "".join(sink.pieces), sink.spans
