"""A sandboxed template language, compiled to Python closures.

Text with `{{ expression }}`, `{% statement %}` and `{# comment #}`:

    for x in list ... endfor        loop.first, loop.last, loop.index, loop.index0 inside
    if / elif / else / endif
    set name = expression
    generation ... endgeneration    marks what the model is to learn

Expressions: literals, names, `a.b` and `a['b']` (entries of dicts and lists only), `+ - * ~`, comparisons,
`in`, `and or not`, `x if c else y`, and filters `x|name`.  Nothing reaches Python attributes, calls or
modules: a name is a variable, and filters come from a fixed table.

Source becomes a syntax tree, constant parts are folded in the tree, and each node becomes one closure.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

#: Control strings open with this; inside texts a backslash parts the two characters.
OPEN = "<|"
_HIDE, _SHOW = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_LINE, _UNLINE = {"\\": "\\\\", "\n": "\\n"}, {"\\\\": "\\", "\\n": "\n"}


def hide(text: str) -> str:
    """Escape control strings: no `<|` is left, and `show` gives the text back."""
    return _HIDE.sub(r"<\\\1|", text) if "|" in text else text


def show(text: str) -> str:
    return _SHOW.sub(r"<\1|", text) if "|" in text else text


def hide_line(text: str) -> str:
    """`hide` for a text that must stay in one line."""
    return hide(re.sub(r"[\\\n]", lambda m: _LINE[m[0]], text))


def show_line(text: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _UNLINE[m[0]], show(text))


def _text(value) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: hide(_text(v)),
    "escape_line": lambda v: hide_line(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
    "json": lambda v: json.dumps(v, ensure_ascii=False),
}


class TemplateError(ValueError):
    pass


# --- syntax tree -----------------------------------------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: object
    key: object


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Emit:
    value: object


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class If:
    branches: list = field(default_factory=list)  # (condition or None, body)


@dataclass
class Set:
    name: str
    value: object


@dataclass
class Generation:
    body: list


# --- parser ----------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*~<>()\[\].|]))", re.S)
_ESCAPE = {"n": "\n", "t": "\t"}
_WORDS = {"true": True, "false": False, "none": None}
_BINARY = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*",)]


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("int", "str", "name", "op"), m.groups()) if v is not None))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else ""

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, text: str) -> None:
        if self.next()[1] != text:
            raise TemplateError(f"{text} is missing")

    def whole(self):
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self):
        value = self.level(0)
        if self.peek() == "if":
            self.next()
            condition = self.level(0)
            self.expect("else")
            return Op("choice", [condition, value, self.choice()])
        return value

    def level(self, k: int):
        if k == len(_BINARY):
            return self.tail()
        if _BINARY[k] == ("not",):
            if self.peek() == "not":
                self.next()
                return Op("not", [self.level(k)])
            return self.level(k + 1)
        left = self.level(k + 1)
        while self.peek() in _BINARY[k]:
            op = self.next()[1]
            left = Op(op, [left, self.level(k + 1)])
        return left

    def tail(self):
        out = self.atom()
        while self.peek() in (".", "[", "|"):
            op = self.next()[1]
            if op == "[":
                out = Item(out, self.choice())
                self.expect("]")
                continue
            kind, name = self.next()
            if kind != "name":
                raise TemplateError(f"a name must follow {op}")
            if op == ".":
                out = Item(out, Const(name))
            elif name in FILTERS:
                out = Filter(name, out)
            else:
                raise TemplateError(f"no filter {name}")
        return out

    def atom(self):
        kind, value = self.next()
        if kind == "int":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        if value == "(":
            out = self.choice()
            self.expect(")")
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """Syntax tree of a template."""
    root: list = []
    stack: list[tuple[object, list]] = [(None, root)]
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][1].append(Emit(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Emit(_Expression(m[1]).whole()))
        elif m[2] is not None:
            _statement(m[2].strip(), stack)
    if source[at:]:
        stack[-1][1].append(Emit(Const(source[at:])))
    if len(stack) > 1:
        raise TemplateError(f"{type(stack[-1][0]).__name__.lower()} is not closed")
    return root


def _statement(text: str, stack: list) -> None:
    word, _, rest = text.partition(" ")
    open_node, body = stack[-1]
    if word == "for":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        if not m:
            raise TemplateError(f"for {rest}")
        node = For(m[1], _Expression(m[2]).whole(), [])
        body.append(node)
        stack.append((node, node.body))
    elif word == "if":
        node = If([(_Expression(rest).whole(), [])])
        body.append(node)
        stack.append((node, node.branches[-1][1]))
    elif word in ("elif", "else") and isinstance(open_node, If) and open_node.branches[-1][0] is not None:
        open_node.branches.append((_Expression(rest).whole() if word == "elif" else None, []))
        stack[-1] = (open_node, open_node.branches[-1][1])
    elif word == "set":
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
        if not m:
            raise TemplateError(f"set {rest}")
        body.append(Set(m[1], _Expression(m[2]).whole()))
    elif word == "generation":
        if any(isinstance(n, Generation) for n, _ in stack):
            raise TemplateError("generation inside generation")
        node = Generation([])
        body.append(node)
        stack.append((node, node.body))
    elif (word, type(open_node)) in (("endfor", For), ("endif", If), ("endgeneration", Generation)):
        stack.pop()
    else:
        raise TemplateError(f"unexpected {text!r}")


# --- values ----------------------------------------------------------------------------------------------


def _item(of, key):
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b if isinstance(a, int) and isinstance(b, int) else _refuse("* takes numbers"),
    "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not": lambda a: not a,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "choice": lambda c, a, b: a if c else b,
}


def _refuse(why: str):
    raise TemplateError(why)


# --- constant folding ------------------------------------------------------------------------------------


def fold(node):
    """The same expression with its constant parts computed."""
    if isinstance(node, Item):
        of, key = fold(node.of), fold(node.key)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_OPS[node.op](*(a.value for a in args)))
            except TypeError:  # it may never be reached; if it is, rendering says so
                return Op(node.op, args)
        if isinstance(args[0], Const) and node.op in ("and", "or", "choice"):
            if node.op == "choice":
                return args[1] if args[0].value else args[2]
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Op(node.op, args)
    return node


def _emits(value) -> list:
    """A text joined from parts becomes one output per part, so that constant parts can meet their neighbours."""
    if isinstance(value, Op) and value.op == "~":
        return [e for a in value.args for e in _emits(a)]
    return [Emit(Const(_text(value.value)) if isinstance(value, Const) else value)]


def fold_body(body: list) -> list:
    """The same statements with constant conditions decided and neighbouring constant texts joined."""
    out: list = []
    for node in body:
        if isinstance(node, Emit):
            new = _emits(fold(node.value))
        elif isinstance(node, For):
            new = [For(node.name, fold(node.over), fold_body(node.body))]
        elif isinstance(node, Set):
            new = [Set(node.name, fold(node.value))]
        elif isinstance(node, Generation):
            new = [Generation(fold_body(node.body))]
        else:
            new = _fold_if(node)
        for n in new:
            if isinstance(n, Emit) and isinstance(n.value, Const):
                if not n.value.value:
                    continue
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(out[-1].value.value + n.value.value))
                    continue
            out.append(n)
    return out


def _fold_if(node: If) -> list:
    branches = []
    for condition, body in node.branches:
        condition = None if condition is None else fold(condition)
        if isinstance(condition, Const):
            if not condition.value:
                continue
            condition = None
        branches.append((condition, fold_body(body)))
        if condition is None:
            break
    if not branches:
        return []
    return branches[0][1] if branches[0][0] is None else [If(branches)]


# --- closures --------------------------------------------------------------------------------------------


class Output:
    """Rendered text so far, and the stretches inside generation marks."""

    def __init__(self):
        self.parts: list[str] = []
        self.size, self.spans, self.began = 0, [], 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.parts), self.spans
        self.parts, self.size, self.spans = [], 0, []
        return out


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda names: value
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda names: _item(of(names), key(names))
    if isinstance(node, Filter):
        of, apply = _value(node.of), FILTERS[node.name]
        return lambda names: apply(of(names))
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.op == "or":
        return lambda names: args[0](names) or args[1](names)
    if node.op == "choice":
        return lambda names: args[1](names) if args[0](names) else args[2](names)
    apply = _OPS[node.op]
    return lambda names: apply(*[a(names) for a in args])


def _body(body: list) -> Callable[[dict, Output], None]:
    steps = [_step(n) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(names, out):
        for s in steps:
            s(names, out)

    return run


def _turns(items: Iterable) -> Iterator[tuple[object, dict]]:
    """Items with their place in the loop, one item ahead."""
    held, k = [], 0
    for item in items:
        if held:
            yield held.pop(), {"index0": k, "index": k + 1, "first": k == 0, "last": False}
            k += 1
        held.append(item)
    if held:
        yield held[0], {"index0": k, "index": k + 1, "first": k == 0, "last": True}


def _step(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            fixed = node.value.value
            return lambda names, out: out.write(fixed)
        value = _value(node.value)
        return lambda names, out: out.write(_text(value(names)))
    if isinstance(node, Set):
        value, name = _value(node.value), node.name
        return lambda names, out: names.__setitem__(name, value(names))
    if isinstance(node, Generation):
        body = _body(node.body)

        def mark(names, out):
            begin = out.size
            body(names, out)
            out.spans.append((begin, out.size))

        return mark
    if isinstance(node, If):
        branches = [(None if c is None else _value(c), _body(b)) for c, b in node.branches]

        def choose(names, out):
            for condition, body in branches:
                if condition is None or condition(names):
                    return body(names, out)

        return choose
    loop = _loop(node)

    def whole(names, out):
        for _ in loop(names, out):
            pass

    return whole


def _loop(node: For):
    over, body, name = _value(node.over), _body(node.body), node.name

    def run(names, out):
        outer = names.get("loop")
        for item, place in _turns(over(names) or ()):
            names[name], names["loop"] = item, place
            body(names, out)
            yield
        names["loop"] = outer

    return run


def _mentions(node, name: str) -> int:
    if isinstance(node, Name):
        return int(node.name == name)
    if isinstance(node, (list, tuple)):
        return sum(_mentions(n, name) for n in node)
    return sum(_mentions(v, name) for v in vars(node).values()) if hasattr(node, "__dataclass_fields__") else 0


class Template:
    """A compiled template; `stream` renders it over the variable `messages`."""

    def __init__(self, source: str):
        self.tree = fold_body(parse(source))
        self.streams = _mentions(self.tree, "messages") == 1 and any(isinstance(n, For) and n.over == Name("messages") for n in self.tree)
        self.steps = [(_loop(n), True) if isinstance(n, For) else (_step(n), False) for n in self.tree]

    def stream(self, messages: Iterable[dict], limit: int = 1 << 20) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Chunks of rendered text with the marked stretches in each, cut between turns of a loop.

        Where the template only walks through `messages` once, they are taken one by one and never held.
        """
        names: dict = {"messages": messages if self.streams else list(messages)}
        out = Output()
        for step, is_loop in self.steps:
            if not is_loop:
                step(names, out)
                continue
            for _ in step(names, out):
                if out.size >= limit:
                    yield out.take()
        yield out.take()

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        text, spans = [], []
        before = 0
        for part, marked in self.stream(messages):
            text.append(part)
            spans += [(a + before, b + before) for a, b in marked]
            before += len(part)
        return "".join(text), spans
