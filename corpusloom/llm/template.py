"""A sandboxed chat template language: parsed into a syntax tree, constants folded, compiled into Python closures.

Statements: {{ value }}, {% set x = value %}, {% for x in xs %}, {% if %} {% elif %} {% else %} {% endif %},
{% generation %} ... {% endgeneration %} around what a model is to learn, {# comment #}; a dash inside a tag strips
the white space beside it. Values: strings, integers, true, false, none, names, x.field, x['field'], x[0], filters
(x|trim), + ~ == != < <= > >= in, not, and, or, a if c else b. Fields are looked up in mappings and items in lists
alone, so no attribute of a Python object can be reached, and there are no calls.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, NamedTuple

Env = dict[str, Any]
Emit = Callable[[str, bool], None]


class TemplateError(ValueError):
    pass


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Filter(NamedTuple):
    of: Any
    name: str


class Op(NamedTuple):
    op: str
    args: tuple


class Text(NamedTuple):
    text: str


class Out(NamedTuple):
    value: Any


class Set(NamedTuple):
    name: str
    value: Any


class For(NamedTuple):
    name: str
    of: Any
    body: tuple


class If(NamedTuple):
    cases: tuple  # of (condition, body)
    other: tuple


class Generation(NamedTuple):
    body: tuple


def _text(x: Any) -> str:
    return "" if x is None else str(x)


OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: a in b, "not": operator.not_, "neg": operator.neg,
}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "string": _text}

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#-?.*?-?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class _Values:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, kind: str, value: str | None = None) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or value not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"{value or kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def value(self) -> Any:
        then = self.either()
        if self.take("if"):
            cond = self.either()
            other = self.value() if self.take("else") else Const(None)
            return Op("if", (cond, then, other))
        return then

    def either(self) -> Any:
        x = self.both()
        while self.take("or"):
            x = Op("or", (x, self.both()))
        return x

    def both(self) -> Any:
        x = self.negated()
        while self.take("and"):
            x = Op("and", (x, self.negated()))
        return x

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        x = self.summed()
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            op = self.tokens[self.at][1]
            self.at += 1
            x = Op(op, (x, self.summed()))
        return x

    def summed(self) -> Any:
        x = self.single()
        while self.peek("+", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            x = Op(op, (x, self.single()))
        return x

    def single(self) -> Any:
        if self.take("-"):
            return Op("neg", (self.single(),))
        if self.take("("):
            x = self.value()
            self.need("op", ")")
        else:
            kind, raw = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            self.at += 1
            if kind == "string":
                x = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), raw[1:-1], flags=re.S))
            elif kind == "int":
                x = Const(int(raw))
            elif kind == "name" and raw.lower() in ("true", "false", "none"):
                x = Const({"true": True, "false": False, "none": None}[raw.lower()])
            elif kind == "name" and raw not in ("if", "else", "and", "or", "not", "in"):
                x = Name(raw)
            else:
                raise TemplateError(f"unexpected {raw!r}")
        while True:
            if self.take("."):
                x = Item(x, Const(self.need("name")))
            elif self.take("["):
                x = Item(x, self.value())
                self.need("op", "]")
            elif self.take("|"):
                x = Filter(x, self.need("name"))
            else:
                return x


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = _TAG.split(source)
    for i in range(1, len(parts), 2):  # dashes strip the text beside their tag
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def block(*ends: str) -> tuple[tuple, str, _Values | None]:
        nonlocal at
        body: list = []
        while at < len(parts):
            part, tag = parts[at], at % 2
            at += 1
            if not tag:
                if part:
                    body.append(Text(part))
                continue
            if part[1] == "#":
                continue
            inner = part[2:-2].strip("-") if part[2] == "-" or part[-3] == "-" else part[2:-2]
            v = _Values(inner)
            if part[1] == "{":
                body.append(Out(v.value()))
                v.end()
                continue
            word = v.need("name")
            if word in ends:
                return tuple(body), word, v
            if word == "set":
                name = v.need("name")
                v.need("op", "=")
                body.append(Set(name, v.value()))
            elif word == "for":
                name = v.need("name")
                v.need("name", "in")
                of = v.value()
                body.append(For(name, of, block("endfor")[0]))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            elif word == "if":
                cases, other, cond = [], (), v.value()
                v.end()
                while True:
                    inside, end, w = block("elif", "else", "endif")
                    if cond is None:
                        other = inside
                    else:
                        cases.append((cond, inside))
                    if end == "endif":
                        break
                    if cond is None:
                        raise TemplateError("a case follows else")
                    cond = w.value() if end == "elif" else None
                body.append(If(tuple(cases), other))
            else:
                raise TemplateError(f"unknown statement {word!r}")
            v.end()
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), "", None

    return block()[0]


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with constant values worked out, constant cases chosen and neighbouring texts joined."""
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Op):
        args = tuple(fold(x, filters) for x in node.args)
        if node.op in ("if", "and", "or"):
            if isinstance(args[0], Const):
                c = args[0].value
                return {"if": lambda: args[1] if c else args[2], "and": lambda: args[1] if c else args[0], "or": lambda: args[0] if c else args[1]}[node.op]()
        elif all(isinstance(x, Const) for x in args):
            return Const(OPS[node.op](*(x.value for x in args)))
        return Op(node.op, args)
    return node


def fold_body(body: Iterable, filters: Mapping[str, Callable]) -> tuple:
    out: list = []

    def add(x: Any) -> None:
        if isinstance(x, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + x.text)
        elif not isinstance(x, Text) or x.text:
            out.append(x)

    for node in body:
        if isinstance(node, Out):
            value = fold(node.value, filters)
            add(Text(_text(value.value)) if isinstance(value, Const) else Out(value))
        elif isinstance(node, Set):
            add(Set(node.name, fold(node.value, filters)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.of, filters), fold_body(node.body, filters)))
        elif isinstance(node, Generation):
            add(Generation(fold_body(node.body, filters)))
        elif isinstance(node, If):
            cases, other = [], fold_body(node.other, filters)
            for cond, inside in node.cases:
                cond, inside = fold(cond, filters), fold_body(inside, filters)
                if isinstance(cond, Const) and not cond.value:
                    continue
                if isinstance(cond, Const):
                    other = inside
                    break
                cases.append((cond, inside))
            if cases:
                add(If(tuple(cases), other))
            else:
                for x in other:
                    add(x)
        else:
            add(node)
    return tuple(out)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[Env], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(env: Env) -> Any:
            x, k = of(env), key(env)
            if isinstance(x, Mapping):
                return x.get(k)
            return x[k] if isinstance(x, (list, tuple)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return item
    if isinstance(node, Filter):
        f, of = filters[node.name], _value(node.of, filters)
        return lambda env: f(of(env))
    args = [_value(x, filters) for x in node.args]
    if node.op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = OPS[node.op]
    if len(args) == 1:
        return lambda env: f(args[0](env))
    return lambda env: f(args[0](env), args[1](env))


def _looped(xs: Iterable) -> Iterator[tuple[Any, dict]]:
    """Items with their loop variables, one item ahead of the input: the input may be a stream."""
    it, i = iter(xs), 0
    for item in it:
        break
    else:
        return
    while True:
        for ahead in it:
            yield item, {"index0": i, "index": i + 1, "first": i == 0, "last": False}
            item, i = ahead, i + 1
            break
        else:
            yield item, {"index0": i, "index": i + 1, "first": i == 0, "last": True}
            return


def _statements(body: tuple, filters: Mapping[str, Callable], inside: bool) -> Callable[[Env, Emit], None]:
    steps: list[Callable[[Env, Emit], None]] = []
    for node in body:
        if isinstance(node, Text):
            steps.append(lambda env, emit, t=node.text: emit(t, inside))
        elif isinstance(node, Out):
            steps.append(lambda env, emit, v=_value(node.value, filters): emit(_text(v(env)), inside))
        elif isinstance(node, Set):
            steps.append(lambda env, emit, n=node.name, v=_value(node.value, filters): env.__setitem__(n, v(env)))
        elif isinstance(node, Generation):
            steps.append(_statements(node.body, filters, True))
        elif isinstance(node, If):
            cases = [(_value(c, filters), _statements(b, filters, inside)) for c, b in node.cases]

            def choose(env: Env, emit: Emit, cases=cases, other=_statements(node.other, filters, inside)) -> None:
                for cond, then in cases:
                    if cond(env):
                        return then(env, emit)
                return other(env, emit)

            steps.append(choose)
        elif isinstance(node, For):

            def loop(env: Env, emit: Emit, n=node.name, of=_value(node.of, filters), then=_statements(node.body, filters, inside)) -> None:
                held = {k: env[k] for k in (n, "loop") if k in env}
                for env[n], env["loop"] in _looped(of(env) or ()):
                    then(env, emit)
                for k in (n, "loop"):
                    env.pop(k, None)
                env.update(held)

            steps.append(loop)

    def run(env: Env, emit: Emit) -> None:
        for step in steps:
            step(env, emit)

    return run


def compiled(source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None) -> Callable[[Env, Emit], None]:
    """A renderer: called with variables and emit(text, learned), it emits the output piece by piece."""
    known = FILTERS | dict(filters or {})
    return _statements(fold_body(parse(source), known), known, False)
