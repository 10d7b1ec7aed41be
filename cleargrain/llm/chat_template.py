"""Chat formatting with a compiled template language.

A template is text with `{{ expression }}`, `{% statement %}` and `{# comment #}`. Statements are `for NAME in
expression ... endfor`, `if ... elif ... else ... endif`, `set NAME = expression` and `generation ... endgeneration`, which marks what
a model is to be trained on. Expressions are literals, names, `a.b`, `a[b]`, `+ - * ~ == != < <= > >= in not and or`,
`x if c else y`, lists, calls of the filters given to `compile_template` as `value | filter`, and `loop.index0`, `loop.index`, `loop.first`
and `loop.last` within a loop. There is nothing else: no attribute of a Python object, no call, no import can be reached, and `.`
and `[]` only look into dicts and lists.

The source is parsed into a syntax tree, constant expressions and conditions are folded and neighbouring text joined,
and the tree becomes Python closures that yield (text, generated) parts as they go. Nothing is evaluated as Python code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass


class TemplateError(ValueError):
    """The template can't be parsed, or a value in it can't be had."""


# --- syntax tree


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Operation:
    sign: str
    operands: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Listing:
    items: tuple


@dataclass(frozen=True)
class Filtered:
    of: object
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Branch:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*~<>().,\[\]|]))""", re.S)
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none", "True", "False", "None"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_COMPARE = {"==", "!=", "<", "<=", ">", ">=", "in"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unreadable at {source[at : at + 20]!r}")
        kind = m.lastgroup
        out.append(("word" if kind == "name" and m["name"] in _WORDS else kind, m[kind]))
        at = m.end()
    return out


class _Expressions:
    """Recursive descent; each level binds tighter than the one before."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "word") else ""

    def accept(self, *texts: str) -> str:
        if (found := self.peek()) and found in texts:
            self.at += 1
            return found
        return ""

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise TemplateError(f"{text!r} is missing")

    def whole(self):
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")
        return out

    def choice(self):
        out = self.binary(0)
        if self.accept("if"):
            test = self.binary(0)
            self.expect("else")
            out = Choice(test, out, self.choice())
        return out

    LEVELS = (("or",), ("and",), None, tuple(_COMPARE), ("~",), ("+", "-"), ("*",))

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.postfix()
        if self.LEVELS[level] is None:
            return Operation("not", (self.binary(level),)) if self.accept("not") else self.binary(level + 1)
        out = self.binary(level + 1)
        while True:
            sign = self.accept(*self.LEVELS[level])
            if not sign and level == 3 and self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                out = Operation("not", (Operation("in", (out, self.binary(level + 1))),))
                continue
            if not sign:
                return out
            out = Operation(sign, (out, self.binary(level + 1)))

    def postfix(self):
        out = self.primary()
        while True:
            if self.accept("."):
                out = Item(out, Constant(self.name()))
            elif self.accept("["):
                out = Item(out, self.choice())
                self.expect("]")
            elif self.accept("|"):
                out = Filtered(out, self.name())
            else:
                return out

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def primary(self):
        if self.accept("("):
            out = self.choice()
            self.expect(")")
            return out
        if self.accept("["):
            items = []
            while not self.accept("]"):
                items.append(self.choice())
                if not self.accept(","):
                    self.expect("]")
                    break
            return Listing(tuple(items))
        if self.accept("-"):
            return Operation("-", (Constant(0), self.postfix()))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Constant(int(text))
        if kind == "string":
            return Constant(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == "name":
            return Name(text)
        if kind == "word" and text.lower() in ("true", "false", "none"):
            return Constant({"true": True, "false": False, "none": None}[text.lower()])
        raise TemplateError(f"{text!r} can't stand here")


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "out" | "do", content); a dash in a tag strips white space beside it."""
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] or m[4] else text
        if text:
            yield "text", text
        if m[2] is not None:
            yield "out", m[2]
        elif m[5] is not None:
            yield "do", m[5].strip()
        strip, at = bool(m[3] or m[6]), m.end()
    text = source[at:].lstrip() if strip else source[at:]
    if text:
        yield "text", text


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    stream = list(_pieces(source))
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(stream):
            kind, content = stream[at]
            at += 1
            if kind == "text":
                out.append(Text(content))
            elif kind == "out":
                out.append(Output(_Expressions(content).whole()))
            else:
                word, _, rest = content.partition(" ")
                if word in ends:
                    return tuple(out), content
                out.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def statement(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m or m[1] in _WORDS:
                raise TemplateError("a loop needs a name and a list")
            body, _ = block("endfor")
            return Loop(m[1], _Expressions(m[2]).whole(), body)
        if word == "if":
            return branch(rest)
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.S)
            if not m or m[1] in _WORDS:
                raise TemplateError("set needs a name and a value")
            return Assign(m[1], _Expressions(m[2]).whole())
        if word == "generation" and not rest:
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    def branch(test: str) -> Branch:
        yes, end = block("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        if word == "elif":
            no = (branch(rest.strip()),)
        else:
            no = block("endif")[0] if word == "else" else ()
        return Branch(_Expressions(test).whole(), yes, no)

    return block()[0]


# --- folding


def _apply(sign: str, values: list):
    try:
        match sign:
            case "not":
                return not values[0]
            case "+":
                return values[0] + values[1]
            case "-":
                return values[0] - values[1]
            case "*":
                if not all(isinstance(v, int) for v in values):
                    raise TypeError
                return values[0] * values[1]
            case "~":
                return _shown(values[0]) + _shown(values[1])
            case "==":
                return values[0] == values[1]
            case "!=":
                return values[0] != values[1]
            case "<":
                return values[0] < values[1]
            case "<=":
                return values[0] <= values[1]
            case ">":
                return values[0] > values[1]
            case ">=":
                return values[0] >= values[1]
            case "in":
                return values[0] in values[1]
    except TypeError as error:
        raise TemplateError(f"{sign!r} doesn't go with these values") from error
    raise TemplateError(f"no operator {sign!r}")


def _shown(value: object) -> str:
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, (bool, int, float)):
        return "" if value is None else str(value)
    raise TemplateError("a list can't be shown")


def folded(node):
    """The tree with constant operations evaluated, dead branches dropped and neighbouring text joined."""
    match node:
        case Operation(sign, operands):
            parts = tuple(map(folded, operands))
            if sign in ("and", "or") and isinstance(parts[0], Constant):
                return parts[1] if bool(parts[0].value) == (sign == "and") else parts[0]
            if sign not in ("and", "or") and all(isinstance(p, Constant) for p in parts):
                return Constant(_apply(sign, [p.value for p in parts]))
            return Operation(sign, parts)
        case Choice(test, yes, no):
            test = folded(test)
            if isinstance(test, Constant):
                return folded(yes if test.value else no)
            return Choice(test, folded(yes), folded(no))
        case Item(of, key):
            return Item(folded(of), folded(key))
        case Listing(items):
            parts = tuple(map(folded, items))
            return Constant([p.value for p in parts]) if all(isinstance(p, Constant) for p in parts) else Listing(parts)
        case Filtered(of, name):
            return Filtered(folded(of), name)
        case _:
            return node


def folded_block(nodes: tuple) -> tuple:
    out: list = []
    for node in nodes:
        match node:
            case Output(of):
                of = folded(of)
                made = (Text(_shown(of.value)),) if isinstance(of, Constant) else (Output(of),)
            case Loop(name, over, body):
                over = folded(over)
                made = () if isinstance(over, Constant) and not over.value else (Loop(name, over, folded_block(body)),)
            case Branch(test, yes, no):
                test = folded(test)
                if isinstance(test, Constant):
                    made = folded_block(yes if test.value else no)
                else:
                    made = (Branch(test, folded_block(yes), folded_block(no)),)
            case Assign(name, value):
                made = (Assign(name, folded(value)),)
            case Generation(body):
                made = (Generation(folded_block(body)),)
            case _:
                made = (node,)
        for x in made:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif not (isinstance(x, Text) and not x.text):
                out.append(x)
    return tuple(out)


# --- closures

Scope = dict[str, object]


def _value(node, filters: dict[str, Callable[[str], str]]) -> Callable[[Scope], object]:
    match node:
        case Constant(value):
            return lambda scope: value
        case Name(name):

            def look(scope: Scope):
                try:
                    return scope[name]
                except KeyError:
                    raise TemplateError(f"no value {name!r}") from None

            return look
        case Item(of, key):
            of_, key_ = _value(of, filters), _value(key, filters)

            def item(scope: Scope):
                holder, k = of_(scope), key_(scope)
                if isinstance(holder, dict) and k in holder:
                    return holder[k]
                if isinstance(holder, list) and isinstance(k, int) and -len(holder) <= k < len(holder):
                    return holder[k]
                raise TemplateError(f"no item {k!r}")

            return item
        case Operation("and", (a, b)):
            a_, b_ = _value(a, filters), _value(b, filters)
            return lambda scope: a_(scope) and b_(scope)
        case Operation("or", (a, b)):
            a_, b_ = _value(a, filters), _value(b, filters)
            return lambda scope: a_(scope) or b_(scope)
        case Operation(sign, operands):
            parts = [_value(o, filters) for o in operands]
            return lambda scope: _apply(sign, [p(scope) for p in parts])
        case Choice(test, yes, no):
            t, y, n = (_value(x, filters) for x in (test, yes, no))
            return lambda scope: y(scope) if t(scope) else n(scope)
        case Listing(items):
            parts = [_value(i, filters) for i in items]
            return lambda scope: [p(scope) for p in parts]
        case Filtered(of, name):
            if name not in filters:
                raise TemplateError(f"no filter {name!r}")
            of_, work = _value(of, filters), filters[name]
            return lambda scope: work(_shown(of_(scope)))
    raise TemplateError(f"no expression {node!r}")


Part = tuple[str, bool]
Body = Callable[[Scope, bool], Iterator[Part]]


def _lasts(values) -> Iterator[tuple[int, object, bool]]:
    """Numbered values with whether each is the last; values may come one at a time."""
    it = iter(values)
    held = next(it, it)
    i = 0
    while held is not it:
        following = next(it, it)
        yield i, held, following is it
        held, i = following, i + 1


def _body(nodes: tuple, filters: dict[str, Callable[[str], str]]) -> Body:
    made: list[Body] = [_node(n, filters) for n in nodes]
    if len(made) == 1:
        return made[0]

    def run(scope: Scope, marked: bool) -> Iterator[Part]:
        for part in made:
            yield from part(scope, marked)

    return run


def _node(node, filters: dict[str, Callable[[str], str]]) -> Body:
    match node:
        case Text(text):

            def literal(scope: Scope, marked: bool) -> Iterator[Part]:
                yield text, marked

            return literal
        case Output(of):
            value = _value(of, filters)

            def show(scope: Scope, marked: bool) -> Iterator[Part]:
                yield _shown(value(scope)), marked

            return show
        case Assign(name, of):
            value = _value(of, filters)

            def assign(scope: Scope, marked: bool) -> Iterator[Part]:
                scope[name] = value(scope)
                return iter(())

            return assign
        case Branch(test, yes, no):
            check, y, n = _value(test, filters), _body(yes, filters), _body(no, filters)
            return lambda scope, marked: y(scope, marked) if check(scope) else n(scope, marked)
        case Generation(body):
            inner = _body(body, filters)
            return lambda scope, marked: inner(scope, True)
        case Loop(name, over, body):
            values, inner = _value(over, filters), _body(body, filters)

            def loop(scope: Scope, marked: bool) -> Iterator[Part]:
                found = values(scope)
                if isinstance(found, (str, dict)) or not hasattr(found, "__iter__"):
                    raise TemplateError("a loop needs a list")
                own = dict(scope)
                for i, value, last in _lasts(found):
                    own[name] = value
                    own["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": last}
                    yield from inner(own, marked)

            return loop
    raise TemplateError(f"no statement {node!r}")


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[Scope], Iterator[Part]]:
    """A function from the template's values to (text, generated) parts."""
    body = _body(folded_block(parse(source)), filters or {})
    return lambda values: body(dict(values), False)
