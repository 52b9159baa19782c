"""Chat templates: a small sandboxed template language, compiled to Python closures.

    {{ expression }}                                     output
    {% for m in messages %} ... {% endfor %}             with loop.index0, loop.first, loop.last
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}             text under the loss mask

Expressions: strings, integers, true, false, none, names, `a.b`, `a | filter`, `not`, `and`, `or`, `==`, `!=`,
`+` (numbers or strings) and parentheses. Names reach only the values given to `render`; `a.b` reads keys of
dicts, never attributes; filters are those of `FILTERS`. There are no calls, so a template cannot leave the
sandbox. The text is parsed to a syntax tree; what has no names is folded to constants, with neighbouring
texts joined and branches of constant conditions chosen; the rest becomes nested closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
                   r"""|(?P<op>==|!=|[+.|()]))""", re.S)
TAG = re.compile(r"(\{%.*?%\}|\{\{.*?\}\})", re.S)
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
# A control string begins "<|"; a text's own "<|", also with backslashes between, gets one backslash more.
MARK, ESCAPED_MARK = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return MARK.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return ESCAPED_MARK.sub(r"<\1|", text) if "|" in text else text


def one_line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def many_lines(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "one_line": one_line, "trim": lambda s: s.strip(" \t\n\r"), "upper": str.upper,
    "lower": str.lower}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: Any
    key: str


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Pair:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return text if kind in ("op", "name") else None

    def take(self, *texts: str) -> str | None:
        if self.peek() in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, "end")
        if kind != "name":
            raise TemplateError(f"a name is expected, not {text!r}")
        self.at += 1
        return text

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Pair("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = Pair("and", tree, self.negated())
        return tree

    def negated(self):
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.summed()
        while op := self.take("==", "!="):
            tree = Pair(op, tree, self.summed())
        return tree

    def summed(self):
        tree = self.filtered()
        while self.take("+"):
            tree = Pair("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while op := self.take(".", "|"):
            name = self.name()
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Member(tree, name) if op == "." else Filter(tree, name)
        return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return tree
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, "end")
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(text))
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return Const(words[text]) if text in words else Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(template: str) -> tuple:
    """The syntax tree."""
    parts = [p for p in TAG.split(template) if p]
    body, at, end = _block(parts, 0, ())
    return body


def _block(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
    nodes: list = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if part.startswith("{{"):
            nodes.append(Output(_Expression(part[2:-2]).whole()))
        elif not part.startswith("{%"):
            nodes.append(Output(Const(part)))
        else:
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in ends:
                return tuple(nodes), at, part[2:-2].strip()
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"not a loop: {part}")
                body, at, _ = _block(parts, at, ("endfor",))
                nodes.append(For(m[1], _Expression(m[2]).whole(), body))
            elif word == "generation":
                body, at, _ = _block(parts, at, ("endgeneration",))
                nodes.append(Generation(body))
            elif word == "if":
                node, at = _branches(parts, at, rest)
                nodes.append(node)
            else:
                raise TemplateError(f"unexpected {part}")
    if ends:
        raise TemplateError(f"{ends[0]} is missing")
    return tuple(nodes), at, ""


def _branches(parts: list[str], at: int, test: str) -> tuple[If, int]:
    then, at, end = _block(parts, at, ("elif", "else", "endif"))
    otherwise: tuple = ()
    if end.startswith("elif"):
        node, at = _branches(parts, at, end[4:])
        otherwise = (node,)
    elif end == "else":
        otherwise, at, _ = _block(parts, at, ("endif",))
    return If(_Expression(test).whole(), then, otherwise), at


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _pair(op: str, left: Any, right: Any) -> Any:
    if op == "+":
        return left + right if isinstance(left, int) and isinstance(right, int) else _text(left) + _text(right)
    return left == right if op == "==" else left != right


def fold(node: Any) -> Any:
    """The node with constants computed."""
    if isinstance(node, tuple):
        nodes: list = []
        for child in map(fold, node):
            for one in child if isinstance(child, tuple) else (child,):
                joins = nodes and all(isinstance(x, Output) and isinstance(x.of, Const) for x in (nodes[-1], one))
                if joins:
                    nodes[-1] = Output(Const(_text(nodes[-1].of.value) + _text(one.of.value)))
                else:
                    nodes.append(one)
        return tuple(nodes)
    if isinstance(node, Output):
        return Output(fold(node.of))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.otherwise)
        return If(test, fold(node.then), fold(node.otherwise))
    if isinstance(node, Member):
        return Member(fold(node.of), node.key)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](_text(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Not):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Pair):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const):
            if node.op == "and":
                return right if left.value else left
            if node.op == "or":
                return left if left.value else right
            if isinstance(right, Const):
                return Const(_pair(node.op, left.value, right.value))
        return Pair(node.op, left, right)
    return node


def _value(node: Any) -> Callable[[dict], Any]:
    """A closure that computes an expression."""
    if isinstance(node, Const):
        constant = node.value
        return lambda names: constant
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Member):
        of, key = _value(node.of), node.key

        def member(names):
            found = of(names)
            return found.get(key) if isinstance(found, dict) else None
        return member
    if isinstance(node, Filter):
        of, apply = _value(node.of), FILTERS[node.name]
        return lambda names: apply(_text(of(names)))
    if isinstance(node, Not):
        of = _value(node.of)
        return lambda names: not of(names)
    left, right, op = _value(node.left), _value(node.right), node.op
    if op == "and":
        return lambda names: left(names) and right(names)
    if op == "or":
        return lambda names: left(names) or right(names)
    return lambda names: _pair(op, left(names), right(names))


@dataclass
class _Page:
    """What has been written, its length, and the spans under the loss mask."""

    parts: list[str]
    spans: list[tuple[int, int]]
    size: int = 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _writer(nodes: tuple) -> Callable[[dict, _Page], None]:
    """A closure that writes a block."""
    steps = [_step(node) for node in nodes]

    def run(names, page):
        for step in steps:
            step(names, page)
    return run


def _step(node: Any) -> Callable[[dict, _Page], None]:
    if isinstance(node, Output) and isinstance(node.of, Const):
        constant = _text(node.of.value)
        return lambda names, page: page.write(constant)
    if isinstance(node, Output):
        value = _value(node.of)
        return lambda names, page: page.write(_text(value(names)))
    if isinstance(node, Generation):
        body = _writer(node.body)

        def generation(names, page):
            begin = page.size
            body(names, page)
            page.spans.append((begin, page.size))
        return generation
    if isinstance(node, If):
        test, then, otherwise = _value(node.test), _writer(node.then), _writer(node.otherwise)
        return lambda names, page: then(names, page) if test(names) else otherwise(names, page)
    over, body, name = _value(node.over), _writer(node.body), node.name

    def loop(names, page):
        items = over(names) or []
        for i, item in enumerate(items):
            body({**names, name: item, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, page)
    return loop


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to the formatted text and the spans under the loss mask."""
    write = _writer(fold(parse(template)))

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        page = _Page([], [])
        write(values, page)
        return "".join(page.parts), page.spans
    return render
