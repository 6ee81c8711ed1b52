"""A small sandboxed template language for chat formats, compiled to Python closures.

    {{ expression }}          writes a value (none writes nothing)
    {% for m in list %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}        for the rest of the enclosing block
    {% generation %} ... {% endgeneration %}    what is written inside is marked as generated
    {# comment #}             a dash inside a tag ({%- -%}) trims white space on that side

Expressions: texts, integers, true, false, none, names, ``a.b`` and ``a[b]``, lists, ``not and or``, comparisons,
``in``, ``+ - * %``, ``~`` (join as text), ``a if c else b`` and filters (``x | name(arguments)``).

Sandbox: values are texts, integers, booleans, none, lists and mappings; ``a.b`` reads a mapping's key and nothing
else (a missing one is none), there are no calls but filters of a given table, loops run over lists only.  A text
that an operation would make longer than ``LONGEST`` raises.

Compilation: source -> tokens -> syntax tree -> folded tree -> closures.  Folding evaluates what consists of
constants only, drops branches that cannot run and joins neighbouring constant texts.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

#: Longest text an operation may build, in code points.
LONGEST = 1 << 30

TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
LEXEME = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)
                        |(?P<op>==|!=|<=|>=|[-+*%~<>().,|\[\]=]))""", re.X | re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template is not in the language, or does what the sandbox forbids."""


# ---- syntax tree

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    """An operation over expressions: an operator, a key look-up or a filter."""
    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- values

def as_text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (str, int)):
        return str(v)
    raise TemplateError(f"cannot write a {type(v).__name__}")


def _bounded(n: int) -> None:
    if n > LONGEST:
        raise TemplateError("text too long")


def _join(a, b):
    a, b = as_text(a), as_text(b)
    _bounded(len(a) + len(b))
    return a + b


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return _join(a, b)
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts or two integers")


def _times(a, b):
    if isinstance(a, int) and isinstance(b, int):
        return a * b
    if isinstance(a, str) and isinstance(b, int):
        _bounded(len(a) * max(b, 0))
        return a * b
    raise TemplateError("* takes integers, or a text and an integer")


def _integers(f):
    def g(a, b):
        if not (isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("integers expected")
        try:
            return f(a, b)
        except ZeroDivisionError as e:
            raise TemplateError(str(e)) from e
    return g


def _ordered(f):
    def g(a, b):
        if type(a) is not type(b) or not isinstance(a, (str, int)):
            raise TemplateError("only two texts or two integers have an order")
        return f(a, b)
    return g


def _get(of, key):
    if isinstance(of, Mapping) and isinstance(key, str):
        return of.get(key)
    if isinstance(of, list) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _contains(a, b):
    if isinstance(b, str):
        return as_text(a) in b
    if isinstance(b, (list, Mapping)):
        return a in b
    raise TemplateError("in takes a text, a list or a mapping")


OPERATIONS: dict[str, Callable] = {
    "+": _add, "~": _join, "*": _times, "-": _integers(operator.sub), "%": _integers(operator.mod),
    "==": operator.eq, "!=": operator.ne, "<": _ordered(operator.lt), "<=": _ordered(operator.le),
    ">": _ordered(operator.gt), ">=": _ordered(operator.ge), "in": _contains, "not": lambda a: not a,
    "get": _get, "list": lambda *a: list(a),
}


def _text_filter(f):
    return lambda v, *a: f(as_text(v), *a)


FILTERS: dict[str, Callable] = {
    "trim": _text_filter(str.strip), "upper": _text_filter(str.upper), "lower": _text_filter(str.lower),
    "length": lambda v: len(v) if isinstance(v, (str, list, Mapping)) else 0,
    "default": lambda v, d="": d if v is None else v,
    "text": as_text,
}


# ---- parsing

def lexemes(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


def _unquote(s: str) -> str:
    def one(m):
        if m.group(1) not in ESCAPES:
            raise TemplateError(f"unknown escape \\{m.group(1)}")
        return ESCAPES[m.group(1)]
    return re.sub(r"\\(.)", one, s[1:-1], flags=re.S)


class ExpressionParser:
    """Precedence climbing, from the loosest to the tightest."""

    LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters, self.source = lexemes(source), 0, filters, source

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected in {self.source!r}")

    def whole(self):
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over in {self.source!r}")
        return e

    def choice(self):
        e = self.either()
        if self.take("if"):
            test = self.either()
            e = Choice(test, e, self.choice() if self.take("else") else Const(None))
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = Call("or", (e, self.both()))
        return e

    def both(self):
        e = self.negation()
        while self.take("and"):
            e = Call("and", (e, self.negation()))
        return e

    def negation(self):
        return Call("not", (self.negation(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.signed()
        e = self.binary(level + 1)
        while True:
            op = self.take(*self.LEVELS[level])
            if op is None and level == 0 and self.peek() == "not":
                self.at += 1
                self.need("in")
                e = Call("not", (Call("in", (e, self.binary(1))),))
            elif op is None:
                return e
            else:
                e = Call(op, (e, self.binary(level + 1)))

    def signed(self):
        return Call("-", (Const(0), self.signed())) if self.take("-") else self.postfix()

    def postfix(self):
        e = self.primary()
        while True:
            if self.take("."):
                e = Call("get", (e, Const(self.word())))
            elif self.take("["):
                e = Call("get", (e, self.choice()))
                self.need("]")
            elif self.take("|"):
                name = self.word()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                e = Call("|" + name, (e, *(self.arguments(")") if self.take("(") else ())))
            else:
                return e

    def arguments(self, end: str) -> tuple:
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.choice())
        return tuple(out)

    def word(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError(f"a name is expected in {self.source!r}")
        self.at += 1
        return value

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(int(value))
        if kind == "text":
            return Const(_unquote(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[value]) if value in fixed else Name(value)
        if value == "(":
            e = self.choice()
            self.need(")")
            return e
        if value == "[":
            return Call("list", self.arguments("]"))
        raise TemplateError(f"{value!r} does not start a value in {self.source!r}")


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """("text", s), ("write", expression), ("tag", statement), with trimming done."""
    at, trim = 0, False
    for m in TAG.finditer(source):
        text = source[at:m.start()]
        left, right = (m.group(1) or m.group(4) or m.group(7)), (m.group(3) or m.group(6) or m.group(9))
        text = text.lstrip() if trim else text
        text = text.rstrip() if left else text
        if text:
            yield "text", text
        if m.group(2) is not None:
            yield "write", m.group(2)
        elif m.group(5) is not None:
            yield "tag", m.group(5).strip()
        at, trim = m.end(), bool(right)
    rest = source[at:].lstrip() if trim else source[at:]
    if rest:
        yield "text", rest


class TemplateParser:
    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.pieces, self.at, self.filters = list(_pieces(source)), 0, filters

    def expression(self, source: str):
        return ExpressionParser(source, self.filters).whole()

    def whole(self) -> tuple:
        body, end = self.block(())
        return body

    def block(self, ends: tuple[str, ...]) -> tuple[tuple, str]:
        out = []
        while self.at < len(self.pieces):
            kind, value = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(Write(Const(value)))
            elif kind == "write":
                out.append(Write(self.expression(value)))
            else:
                word = value.split(None, 1)[0] if value else ""
                rest = value[len(word):].strip()
                if word in ends:
                    return tuple(out), value
                out.append(self.statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def statement(self, word: str, rest: str):
        if word == "if":
            return self.branch(rest)
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            return For(m.group(1), self.expression(m.group(2)), self.block(("endfor",))[0])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read set {rest!r}")
            return Set(m.group(1), self.expression(m.group(2)))
        if word == "generation" and not rest:
            return Generation(self.block(("endgeneration",))[0])
        raise TemplateError(f"unknown or misplaced tag {word!r}")

    def branch(self, test: str) -> If:
        yes, end = self.block(("elif", "else", "endif"))
        if end.startswith("elif"):
            return If(self.expression(test), yes, (self.branch(end[4:].strip()),))
        no = self.block(("endif",))[0] if end == "else" else ()
        return If(self.expression(test), yes, no)


# ---- folding

def fold(e, filters: Mapping[str, Callable]):
    """An expression with everything evaluated that holds constants only."""
    if isinstance(e, Choice):
        test = fold(e.test, filters)
        if isinstance(test, Const):
            return fold(e.yes if test.value else e.no, filters)
        return Choice(test, fold(e.yes, filters), fold(e.no, filters))
    if not isinstance(e, Call):
        return e
    args = tuple(fold(a, filters) for a in e.args)
    if e.op in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.op == "and") else args[0]
        return Call(e.op, args)
    if e.op != "list" and all(isinstance(a, Const) for a in args):
        f = filters[e.op[1:]] if e.op[0] == "|" else OPERATIONS[e.op]
        return Const(f(*[a.value for a in args]))
    return Call(e.op, args)


def fold_block(body: Iterable, filters: Mapping[str, Callable]) -> tuple:
    out: list = []
    for s in body:
        if isinstance(s, Write):
            s = Write(fold(s.value, filters))
            if isinstance(s.value, Const):
                text = as_text(s.value.value)
                if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if not text:
                    continue
                s = Write(Const(text))
        elif isinstance(s, If):
            test = fold(s.test, filters)
            if isinstance(test, Const):
                inner = fold_block(s.yes if test.value else s.no, filters)
                if any(isinstance(x, Set) for x in inner):      # a name set inside ends with the branch
                    out.append(If(Const(True), inner, ()))
                else:
                    out = list(fold_block([*out, *inner], filters))
                continue
            s = If(test, fold_block(s.yes, filters), fold_block(s.no, filters))
        elif isinstance(s, For):
            s = For(s.name, fold(s.items, filters), fold_block(s.body, filters))
        elif isinstance(s, Set):
            s = Set(s.name, fold(s.value, filters))
        elif isinstance(s, Generation):
            s = Generation(fold_block(s.body, filters))
        out.append(s)
    return tuple(out)


def names_read(node) -> set[str]:
    """Names an expression, statement or block looks up (``loop.x`` as "loop.x")."""
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, Call):
        if node.op == "get" and node.args[0] == Name("loop") and isinstance(node.args[1], Const):
            return {f"loop.{node.args[1].value}"}
        return set().union(*map(names_read, node.args)) if node.args else set()
    if isinstance(node, tuple):
        return set().union(*map(names_read, node)) if node else set()
    if isinstance(node, Const):
        return set()
    return set().union(*(names_read(getattr(node, f)) for f in node.__dataclass_fields__ if f != "name"))


# ---- closures

@dataclass
class Output:
    """What has been written: pieces, their length, and the spans written under a generation tag."""
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.pieces)


def _expression(e, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.name
        return lambda env: env.get(name)
    if isinstance(e, Choice):
        test, yes, no = (_expression(x, filters) for x in (e.test, e.yes, e.no))
        return lambda env: yes(env) if test(env) else no(env)
    args = [_expression(a, filters) for a in e.args]
    if e.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.op == "or":
        return lambda env: args[0](env) or args[1](env)
    f = filters[e.op[1:]] if e.op[0] == "|" else OPERATIONS[e.op]
    if len(args) == 1:
        one = args[0]
        return lambda env: f(one(env))
    if len(args) == 2:
        one, two = args
        return lambda env: f(one(env), two(env))
    return lambda env: f(*[a(env) for a in args])


def _statement(s, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    if isinstance(s, Write):
        if isinstance(s.value, Const):
            text = s.value.value
            return lambda env, out: out.write(text)
        value = _expression(s.value, filters)
        return lambda env, out: out.write(as_text(value(env)))
    if isinstance(s, Set):
        name, value = s.name, _expression(s.value, filters)

        def assign(env, out):
            env[name] = value(env)
        return assign
    if isinstance(s, If):
        test, yes, no = _expression(s.test, filters), closure(s.yes, filters), closure(s.no, filters)
        return lambda env, out: (yes if test(env) else no)(dict(env), out)
    if isinstance(s, Generation):
        body = closure(s.body, filters)

        def generate(env, out):
            start = out.length
            body(dict(env), out)
            if out.length > start:
                out.spans.append((start, out.length))
        return generate
    name, items, body = s.name, _expression(s.items, filters), closure(s.body, filters)

    def repeat(env, out):
        found = items(env)
        if found is not None and not isinstance(found, list):
            raise TemplateError("for runs over lists only")
        for i, v in enumerate(found or []):
            body({**env, name: v, "loop": loop_state(i, found[i - 1] if i else None, i == len(found) - 1,
                                                     found[i + 1] if i + 1 < len(found) else None)}, out)
    return repeat


def loop_state(i: int, previous, last: bool, following) -> dict:
    return {"index0": i, "index": i + 1, "first": i == 0, "last": last, "previtem": previous, "nextitem": following}


def closure(body: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    steps = [_statement(s, filters) for s in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for step in steps:
            step(env, out)
    return run


class Template:
    """A compiled template.  Pickles as its source: executors compile it anew."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        self.source = source
        self.filters = {**FILTERS, **(filters or {})}
        self.tree = fold_block(TemplateParser(source, self.filters).whole(), self.filters)
        self._run = closure(self.tree, self.filters)

    def __reduce__(self):
        return Template, (self.source, {k: f for k, f in self.filters.items() if FILTERS.get(k) is not f})

    def render(self, **values) -> Output:
        out = Output()
        self._run(dict(values), out)
        return out

    def turns(self, name: str = "messages") -> tuple[Callable, str, Callable, Callable, set[str]]:
        """(head, loop variable, turn, tail, loop fields the turn reads) of a template that is one top-level loop over
        ``name`` with constant text or given values before and after it, so that a conversation can be
        rendered turn by turn.  Raises ``TemplateError`` for others: they would need a conversation held whole."""
        loops = [i for i, s in enumerate(self.tree) if isinstance(s, For) and s.items == Name(name)]
        if len(loops) != 1:
            raise TemplateError(f"one top-level loop over {name} is needed to render turn by turn")
        i = loops[0]
        loop = self.tree[i]
        read = names_read(loop.body)
        if name in names_read(self.tree[:i] + self.tree[i + 1:]) | read or "loop" in read:
            raise TemplateError(f"{name} or loop as a whole is used: the template cannot be rendered turn by turn")
        if any(isinstance(s, Set) for s in self.tree):
            raise TemplateError("set outside the loop: the template cannot be rendered turn by turn")
        return (closure(self.tree[:i], self.filters), loop.name, closure(loop.body, self.filters),
                closure(self.tree[i + 1:], self.filters), {r for r in read if r.startswith("loop.")})
