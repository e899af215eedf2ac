"""A small sandboxed template language, compiled to Python closures.

Source text is parsed into a syntax tree, constant parts of the tree are folded, and the tree becomes closures that yield
pieces of output. Only names given to ``render``, loop variables, their plain fields and the filters below can be reached;
there are no calls and no attributes of Python objects.

    {{ expression }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}   {% for x in e %}..{% endfor %}
    {% generation %}..{% endgeneration %}

Expressions: strings, whole numbers, true, false, none, names, ``a.b``, ``a['b']``, ``==``, ``!=``, ``+`` (joins text),
``and``, ``or``, ``not``, parentheses and ``value | filter``. In a loop, ``loop.index0``, ``loop.first`` and ``loop.last``
are known. A loop reads its rows one by one, so a conversation need not fit in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

Piece = tuple[str, bool]

#: A control string begins with ``<|``. In a text, one backslash more between the two marks keeps it apart.
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left; ``unescape`` gives the text back."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_line(text: str) -> str:
    """As ``escape``, and on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "escape": lambda v: escape(_text(v)), "escape_line": lambda v: escape_line(_text(v)), "length": lambda v: len(_text(v)),
}


class TemplateError(ValueError):
    pass


_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.\[\]()+|]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_CONSTANTS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over one expression; nodes are tuples whose first item names them."""

    def __init__(self, source: str):
        self.source, self.items, at = source, [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if m is None:
                raise TemplateError(f"unexpected text in {source.strip()!r}")
            self.items.append(next((k, g) for k, g in zip(("text", "int", "name", "mark"), m.groups(), strict=True) if g is not None))
            at = m.end()
        self.items.append(("end", ""))

    def tree(self) -> tuple:
        node = self.either()
        if self.items[0][0] != "end":
            raise TemplateError(f"unexpected {self.items[0][1]!r} in {self.source.strip()!r}")
        return node

    def take(self, *values: str) -> str | None:
        if self.items[0][0] in ("mark", "name") and self.items[0][1] in values:
            return self.items.pop(0)[1]
        return None

    def need(self, value: str) -> None:
        if self.take(value) is None:
            raise TemplateError(f"{value!r} is missing in {self.source.strip()!r}")

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while mark := self.take("==", "!="):
            node = (mark, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.plain()
        while self.take("|"):
            kind, name = self.items.pop(0)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("filter", name, node)
        return node

    def plain(self) -> tuple:
        kind, value = self.items.pop(0)
        if kind == "text":
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        elif kind == "int":
            node = ("const", int(value))
        elif kind == "name" and value not in ("and", "or", "not", "in"):
            node = ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        elif value == "(":
            node = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r} in {self.source.strip()!r}")
        while mark := self.take(".", "["):
            kind, value = self.items.pop(0)
            if kind != ("name" if mark == "." else "text"):
                raise TemplateError(f"a field name is missing in {self.source.strip()!r}")
            node = ("field", node, value if mark == "." else value[1:-1])
            if mark == "[":
                self.need("]")
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", parts)."""
    parts, at = [], 0
    for m in _PART.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("put", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if source[at:]:
        parts.append(("text", source[at:]))
    parts.reverse()
    tree = _block(parts, ())
    return tree


def _block(parts: list[tuple], ends: tuple[str, ...]) -> tuple:
    """Nodes up to one of the closing tags, which stays in ``parts``."""
    nodes = []
    while parts:
        kind, value = parts[-1]
        word = value.split(None, 1)[0] if kind == "tag" and value else ""
        if kind == "tag" and word in ends:
            return ("block", nodes)
        parts.pop()
        if kind == "text":
            nodes.append(("write", ("const", value)))
        elif kind == "put":
            nodes.append(("write", _Expression(value).tree()))
        elif word == "if":
            nodes.append(_branches(parts, value[2:]))
        elif word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value, re.S)
            if m is None:
                raise TemplateError(f"bad loop {value!r}")
            body = _block(parts, ("endfor",))
            _close(parts, "endfor")
            nodes.append(("for", m[1], _Expression(m[2]).tree(), body))
        elif word == "generation":
            body = _block(parts, ("endgeneration",))
            _close(parts, "endgeneration")
            nodes.append(("generation", body))
        else:
            raise TemplateError(f"unexpected tag {value!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return ("block", nodes)


def _close(parts: list[tuple], word: str) -> None:
    if not parts or parts[-1][1] != word:
        raise TemplateError(f"{word!r} is missing")
    parts.pop()


def _branches(parts: list[tuple], test: str) -> tuple:
    then = _block(parts, ("elif", "else", "endif"))
    _, value = parts.pop()
    if value.startswith("elif"):
        other = ("block", [_branches(parts, value[4:])])
    elif value == "else":
        other = _block(parts, ("endif",))
        _close(parts, "endif")
    else:
        other = ("block", [])
    return ("if", _Expression(test).tree(), then, other)


def fold(node: tuple) -> tuple:
    """The tree with constant expressions computed, dead branches dropped and neighbouring constant output joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "write" and y[1][0] == "const":
                    if out and out[-1][0] == "write" and out[-1][1][0] == "const":
                        y = ("write", ("const", _text(out.pop()[1][1]) + _text(y[1][1])))
                    if _text(y[1][1]) == "":
                        continue
                out.append(y)
        return ("block", out)
    if kind == "write":
        return ("write", fold(node[1]))
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node[1:])
    node = (kind, *parts)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _value(node)({}))
    return node


def _value(node: tuple) -> Callable[[Mapping], Any]:
    """A closure that computes an expression from the variables."""
    kind = node[0]
    if kind == "const":
        return lambda _, v=node[1]: v
    if kind == "name":
        return lambda scope, k=node[1]: scope.get(k)
    if kind == "field":
        inner, key = _value(node[1]), node[2]

        def field(scope):
            held = inner(scope)
            return held.get(key) if isinstance(held, Mapping) else None

        return field
    if kind == "filter":
        inner, use = _value(node[2]), FILTERS[node[1]]
        return lambda scope: use(inner(scope))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    a, b = _value(node[1]), _value(node[2])
    return {
        "or": lambda scope: a(scope) or b(scope), "and": lambda scope: a(scope) and b(scope), "+": lambda scope: _text(a(scope)) + _text(b(scope)),
        "==": lambda scope: a(scope) == b(scope), "!=": lambda scope: a(scope) != b(scope),
    }[kind]


def _writer(node: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    """A closure that yields what a statement writes; its last argument tells whether that is generated text."""
    kind = node[0]
    if kind == "block":
        steps = [_writer(x) for x in node[1]]

        def block(scope, made):
            for step in steps:
                yield from step(scope, made)

        return block
    if kind == "write":
        if node[1][0] == "const":
            piece = _text(node[1][1])
            return lambda scope, made: ((piece, made),)
        value = _value(node[1])
        return lambda scope, made: ((_text(value(scope)), made),)
    if kind == "if":
        test, then, other = _value(node[1]), _writer(node[2]), _writer(node[3])
        return lambda scope, made: (then if test(scope) else other)(scope, made)
    if kind == "generation":
        body = _writer(node[1])
        return lambda scope, made: body(scope, True)
    name, rows, body = node[1], _value(node[2]), _writer(node[3])

    def loop(scope, made):
        left = iter(rows(scope) or ())
        row, index = next(left, loop), 0
        while row is not loop:
            after = next(left, loop)
            yield from body(scope | {name: row, "loop": {"index0": index, "first": index == 0, "last": after is loop}}, made)
            row, index = after, index + 1

    return loop


def compile_template(source: str) -> Callable[[Iterable[Mapping[str, Any]]], Iterator[Piece]]:
    """``render(messages)`` yields pieces of output, each with whether it is marked as generated."""
    write = _writer(fold(parse(source)))
    return lambda messages: iter(write({"messages": messages}, False))
