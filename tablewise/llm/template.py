"""A small sandboxed template language for conversations, compiled to Python closures.

    {{ value }}   {% if a %}..{% elif b %}..{% else %}..{% endif %}   {% set name = value %}
    {% for message in messages %}..{% endfor %}   {% generation %}..{% endgeneration %}   {# note #}

A dash inside a bracket (``{%-``, ``-}}``) removes the white space on that side. Values are strings, whole
numbers, ``true``, ``false``, ``none``, names, ``a.key`` and ``a['key']``, ``== != < <= > >= in``, ``not in``, ``and or
not``, ``+ - %`` on numbers, ``~`` to join strings, ``a if c else b`` and filters (``value | name(arguments)``).

Nothing outside the template can be reached: names are those that the template sets, the constants it is
compiled with and the fields of a message; a key is looked up in mappings only, never among Python's attributes; the
only functions are the filters; there are no calls, no unbounded loops and no operator that multiplies strings.

``messages`` is looped over once, at the top level, and stands nowhere else, so that a conversation can be
rendered in parts: what comes before the loop, some messages, what comes after. Inside the loop ``loop.index0``,
``loop.index``, ``loop.first`` and ``loop.last`` are known; what a pass sets ends with it. Text inside ``generation`` is
marked: its places in the output, in code points, are returned beside the text.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

MESSAGES = "messages"
Env = dict[str, Any]


class TemplateError(ValueError):
    """The template can't be read, or reaches for what it isn't given."""


# Syntax tree. Values:
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    """An operator or a filter and the values it takes; all of them are free of side effects."""

    name: str
    function: Callable[..., Any]
    values: tuple


@dataclass(frozen=True)
class Choice:
    """``then`` if ``test`` holds, else ``other``; ``and`` and ``or`` are choices too, with ``None`` for the test's own value."""

    test: Any
    then: Any
    other: Any


# Statements:
@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _key(base: Any, key: Any) -> Any:
    if not isinstance(base, Mapping):
        raise TemplateError(f"no keys in a value of type {type(base).__name__}")
    return base.get(key)


def _number(function: Callable[[int, int], int]) -> Callable[[Any, Any], int]:
    def run(left, right):
        if type(left) is not int or type(right) is not int:
            raise TemplateError("+, - and % are for whole numbers; ~ joins strings")
        return function(left, right)

    return run


def text_of(value: Any) -> str:
    """What a value looks like in the output: nothing for none."""
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    raise TemplateError(f"a value of type {type(value).__name__} has no text")


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: text_of(v).strip(), "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(),
    "length": lambda v: len(text_of(v)), "string": text_of, "default": lambda v, other: other if v is None else v,
    "replace": lambda v, old, new: text_of(v).replace(old, new) if old else text_of(v),
}
_COMPARE = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: text_of(a) in text_of(b), "not in": lambda a, b: text_of(a) not in text_of(b),
}
_SUMS = {"+": _number(operator.add), "-": _number(operator.sub), "%": _number(operator.mod), "~": lambda a, b: text_of(a) + text_of(b)}
#: From those that bind least.
_LEVELS = (("~",), ("+", "-"), ("%",))
_SIGN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+\-%~|.,()\[\]]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_BRACKET = re.compile(r"\{(?:\{(-?)(.*?)(-?)\}|%(-?)(.*?)(-?)%|#(-?)(.*?)(-?)#)\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Values:
    """Reads one value by recursive descent."""

    def __init__(self, source: str, filters: Mapping[str, Callable[..., Any]]) -> None:
        self.signs, self.at, self.filters, place = [], 0, filters, 0
        source = source.strip()
        while place < len(source):
            found = _SIGN.match(source, place)
            if not found:
                raise TemplateError(f"can't read {source[place:]!r}")
            self.signs.append((found.lastgroup, found[found.lastgroup]))
            place = found.end()

    def next_is(self, *words: str) -> str | None:
        kind, word = self.signs[self.at] if self.at < len(self.signs) else (None, None)
        if kind in ("name", "sign") and word in words:
            self.at += 1
            return word
        return None

    def need(self, word: str) -> None:
        if not self.next_is(word):
            raise TemplateError(f"{word!r} is missing")

    def whole(self) -> Any:
        value = self.choice()
        if self.at < len(self.signs):
            raise TemplateError(f"{self.signs[self.at][1]!r} is not expected here")
        return value

    def choice(self) -> Any:
        value = self.either()
        if self.next_is("if"):
            test = self.either()
            return Choice(test, value, self.choice() if self.next_is("else") else Const(None))
        return value

    def either(self) -> Any:
        value = self.both()
        while self.next_is("or"):
            value = Choice(value, None, self.both())
        return value

    def both(self) -> Any:
        value = self.inverted()
        while self.next_is("and"):
            value = Choice(value, self.inverted(), None)
        return value

    def inverted(self) -> Any:
        return Call("not", operator.not_, (self.inverted(),)) if self.next_is("not") else self.compared()

    def compared(self) -> Any:
        value = self.summed()
        while sign := self.next_is(*_COMPARE, "not"):
            if sign == "not":
                self.need("in")
                sign = "not in"
            value = Call(sign, _COMPARE[sign], (value, self.summed()))
        return value

    def summed(self, level: int = 0) -> Any:
        if level == len(_LEVELS):
            return self.single()
        value = self.summed(level + 1)
        while sign := self.next_is(*_LEVELS[level]):
            value = Call(sign, _SUMS[sign], (value, self.summed(level + 1)))
        return value

    def single(self) -> Any:
        if self.at >= len(self.signs):
            raise TemplateError("a value is missing")
        kind, word = self.signs[self.at]
        self.at += 1
        if kind == "text":
            value = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "number":
            value = Const(int(word))
        elif kind == "name":
            value = Const(_WORDS[word]) if word in _WORDS else Name(word)
        elif word == "(":
            value = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"{word!r} is not a value")
        while sign := self.next_is(".", "[", "|"):
            if sign == "[":
                value = Call("key", _key, (value, self.choice()))
                self.need("]")
                continue
            kind, word = self.signs[self.at] if self.at < len(self.signs) else (None, None)
            if kind != "name":
                raise TemplateError(f"a name is missing after {sign!r}")
            self.at += 1
            value = Call("key", _key, (value, Const(word))) if sign == "." else self.filtered(word, value)
        return value

    def filtered(self, name: str, value: Any) -> Any:
        if name not in self.filters:
            raise TemplateError(f"no filter {name!r}")
        values = [value]
        if self.next_is("("):
            while not self.next_is(")"):
                values.append(self.choice())
                self.next_is(",")
        return Call(name, self.filters[name], tuple(values))


class _Statements:
    """Reads the statements of a template."""

    def __init__(self, source: str, filters: Mapping[str, Callable[..., Any]]) -> None:
        self.filters, self.parts, self.at, place, strip = filters, [], 0, 0, False
        for found in _BRACKET.finditer(source):
            left, inside, right = (part for part in found.groups() if part is not None)
            text = source[place : found.start()]
            text = text.lstrip() if strip else text
            self.parts.append(("text", text.rstrip() if left else text))
            if (kind := found[0][1]) != "#":
                self.parts.append((kind, inside.strip()))
            place, strip = found.end(), bool(right)
        self.parts.append(("text", source[place:].lstrip() if strip else source[place:]))
        if any(kind == "text" and re.search(r"\{[{%#]|[%#}]\}", text) for kind, text in self.parts):
            raise TemplateError("a bracket isn't closed or not opened")

    def value(self, source: str) -> Any:
        return _Values(source, self.filters).whole()

    def block(self, *ends: str) -> tuple[tuple, str]:
        """Statements up to one of the ``ends``, and that end with what follows it."""
        found: list[Any] = []
        while self.at < len(self.parts):
            kind, inside = self.parts[self.at]
            self.at += 1
            if kind == "text":
                found += [Text(inside)] if inside else []
            elif kind == "{":
                found.append(Print(self.value(inside)))
            else:
                word, _, rest = inside.partition(" ")
                if word in ends:
                    return tuple(found), inside
                found.append(self.statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(found), ""

    def statement(self, word: str, rest: str) -> Any:
        if word == "if":
            return self.condition(rest)
        if word == "set" and (found := re.fullmatch(r"([A-Za-z_]\w*)\s*=(.*)", rest, re.S)):
            return Set(found[1], self.value(found[2]))
        if word == "for" and (found := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest)):
            return For(found[1], self.block("endfor")[0])
        if word == "generation" and not rest:
            return Generation(self.block("endgeneration")[0])
        raise TemplateError(f"can't read {{% {word} {rest} %}}")

    def condition(self, test: str) -> If:
        value = self.value(test)
        then, end = self.block("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        if word == "elif":
            return If(value, then, (self.condition(rest),))
        return If(value, then, self.block("endif")[0] if word == "else" else ())


def parse(source: str, filters: Mapping[str, Callable[..., Any]] = FILTERS) -> tuple:
    """The statements of a template."""
    return _Statements(source, filters).block()[0]


def fold_value(value: Any, constants: Mapping[str, Any]) -> Any:
    """The value with everything computed that doesn't depend on a conversation."""
    if isinstance(value, Name):
        return Const(constants[value.name]) if value.name in constants else value
    if isinstance(value, Call):
        values = tuple(fold_value(v, constants) for v in value.values)
        if all(isinstance(v, Const) for v in values):
            return Const(value.function(*(v.value for v in values)))
        return Call(value.name, value.function, values)
    if isinstance(value, Choice):
        test, then, other = (v and fold_value(v, constants) for v in (value.test, value.then, value.other))
        if isinstance(test, Const):
            return (then if test.value else other) or test
        return Choice(test, then, other)
    return value


def fold(statements: Iterable[Any], constants: Mapping[str, Any]) -> tuple:
    """Statements with folded values: branches that are never taken go, texts that meet become one."""
    found: list[Any] = []

    def add(statement: Any) -> None:
        if isinstance(statement, Text) and found and isinstance(found[-1], Text):
            found[-1] = Text(found[-1].text + statement.text)
        elif not (isinstance(statement, Text) and not statement.text):
            found.append(statement)

    for statement in statements:
        if isinstance(statement, Print):
            value = fold_value(statement.value, constants)
            add(Text(text_of(value.value)) if isinstance(value, Const) else Print(value))
        elif isinstance(statement, If):
            test, then, other = fold_value(statement.test, constants), fold(statement.then, constants), fold(statement.other, constants)
            if isinstance(test, Const):
                for inner in then if test.value else other:
                    add(inner)
            elif then or other:
                add(If(test, then, other))
        elif isinstance(statement, Set):
            add(Set(statement.name, fold_value(statement.value, constants)))
        elif isinstance(statement, (For, Generation)):
            body = fold(statement.body, constants)
            add(For(statement.name, body) if isinstance(statement, For) else Generation(body))
        else:
            add(statement)
    return tuple(found)


def _nested(statements: Iterable[Any]) -> Iterable[Any]:
    for statement in statements:
        yield statement
        for part in (getattr(statement, name, ()) for name in ("then", "other", "body")):
            yield from _nested(part)


@dataclass
class Rendering:
    """Text so far and the places of its generated parts."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def value_closure(value: Any) -> Callable[[Env], Any]:
    if isinstance(value, Const):
        constant = value.value
        return lambda env: constant
    if isinstance(value, Name):
        name = value.name

        def look(env):
            if name not in env:
                raise TemplateError(f"{name!r} isn't known")
            return env[name]

        return look
    if isinstance(value, Call):
        function, values = value.function, [value_closure(v) for v in value.values]
        if len(values) == 1:
            only = values[0]
            return lambda env: function(only(env))
        return lambda env: function(*[v(env) for v in values])
    test = value_closure(value.test)
    then, other = (value_closure(v) if v else None for v in (value.then, value.other))

    def choose(env):
        tested = test(env)
        branch = then if tested else other
        return branch(env) if branch else tested

    return choose


def closure(statements: Iterable[Any]) -> Callable[[Env, Rendering], None]:
    """One function that renders the statements."""
    steps = [_step(s) for s in statements]

    def run(env, out):
        for step in steps:
            step(env, out)

    return run


def _step(statement: Any) -> Callable[[Env, Rendering], None]:
    if isinstance(statement, Text):
        text = statement.text
        return lambda env, out: out.add(text)
    if isinstance(statement, Print):
        value = value_closure(statement.value)
        return lambda env, out: out.add(text_of(value(env)))
    if isinstance(statement, Set):
        name, given = statement.name, value_closure(statement.value)
        return lambda env, out: env.__setitem__(name, given(env))
    if isinstance(statement, If):
        test, then, other = value_closure(statement.test), closure(statement.then), closure(statement.other)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    body = closure(statement.body)

    def generate(env, out):
        start = out.length
        body(env, out)
        out.spans.append((start, out.length))

    return generate


class Template:
    """A compiled template: ``head``, one pass of the loop for a message, and ``tail``."""

    def __init__(self, source: str, constants: Mapping[str, Any] | None = None, filters: Mapping[str, Callable[..., Any]] | None = None) -> None:
        constants = dict(constants or {})
        parsed = parse(source, {**FILTERS, **(filters or {})})
        set_names = {s.name for s in _nested(parsed) if isinstance(s, (Set, For))}
        if set_names & ({MESSAGES, "loop"} | constants.keys()):
            raise TemplateError(f"{sorted(set_names & ({MESSAGES, 'loop'} | constants.keys()))} can't be set")
        self.tree = fold(parsed, constants)
        loops = [i for i, s in enumerate(self.tree) if isinstance(s, For)]
        if len(loops) != 1 or sum(isinstance(s, For) for s in _nested(self.tree)) != 1:
            raise TemplateError("a template has one loop over the messages, at its top level")
        for outer in _nested(self.tree):
            if isinstance(outer, Generation) and any(isinstance(s, Generation) for s in _nested(outer.body)):
                raise TemplateError("a generation inside a generation")
        loop = self.tree[loops[0]]
        self.variable = loop.name
        self.head, self.body, self.tail = closure(self.tree[: loops[0]]), closure(loop.body), closure(self.tree[loops[0] + 1 :])

    def begin(self, out: Rendering | None = None) -> Env:
        """Render what comes before the loop; without ``out`` only its settings are taken over."""
        env: Env = {}
        self.head(env, Rendering() if out is None else out)
        return env

    def message(self, env: Env, out: Rendering, message: Mapping[str, Any], index: int, last: bool) -> None:
        """Render one message, the ``index``-th from 0."""
        self.body({**env, self.variable: message, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": last}}, out)

    def render(self, messages: Iterable[Mapping[str, Any]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of a whole conversation, and the places of its generated parts."""
        out, messages = Rendering(), list(messages)
        env = self.begin(out)
        for index, message in enumerate(messages):
            self.message(env, out, message, index, index == len(messages) - 1)
        self.tail(env, out)
        return "".join(out.parts), out.spans
