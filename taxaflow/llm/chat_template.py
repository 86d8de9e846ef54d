"""Chat formatting: a template compiler and its distributed use.

The language is a sandboxed subset in the familiar double-brace style:

    {{ expression }}
    {% for m in messages %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}        marks the output inside as text the model is to produce
    {# comment #}

Expressions: names, strings, integers, true/false/none, a.b, ==, !=, in, not, and, or, + and ~ (join), parentheses, and
filters `x | name` or `x | name(args)` from a fixed table. There is no call, index, attribute of a Python object or
import: names reach only the mapping given to render. Source is parsed to a syntax tree, constants are folded (joined
literals, filters of literals, branches of constant conditions, adjacent text), and the tree is turned into Python
closures that write to a sink.

Distributed: rows are range-partitioned by (conv_id, turn, role, text), so a hot conversation spans many tasks. A
template whose output is only its loop over messages, without loop variables, is rendered run by run; conversations that
cross a partition's edge are finished from their parts, which stream in order through one task (SHA-256 is sequential by
nature; nothing is gathered in memory). Other templates hold one conversation at a time in one task.

Null role or text is empty; null conv_id is a conversation of its own; rows sort by turn (nulls first), then role, then
text, so ties and repeats have one order; an empty table gives no rows but the ones added by the query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
WORD = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+~|().,]))""", re.S)


class TemplateError(ValueError):
    pass


def escape(text: str, controls: tuple[str, ...]) -> str:
    """Backslash before every backslash and every control string. unescape() reverses it."""
    return _escaper(controls).sub(lambda m: "\\" + m[0], text)


def unescape(text: str, controls: tuple[str, ...]) -> str:
    return _unescaper(controls).sub(lambda m: m[1], text)


@lru_cache(64)
def _escaper(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, ("\\", *sorted(controls, key=len, reverse=True)))))


@lru_cache(64)
def _unescaper(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\\(" + "|".join(map(re.escape, ("\\", *sorted(controls, key=len, reverse=True)))) + ")", re.S)


FILTERS: dict[str, Callable] = {
    "escape": lambda x, *controls: escape("" if x is None else str(x), controls),
    "trim": lambda x: ("" if x is None else str(x)).strip(),
    "upper": lambda x: ("" if x is None else str(x)).upper(),
    "lower": lambda x: ("" if x is None else str(x)).lower(),
    "capitalize": lambda x: ("" if x is None else str(x)).capitalize(),
    "default": lambda x, other="": other if x is None else x,
    "length": lambda x: len(x or ""),
}


# --- syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    path: tuple[str, ...]


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Filter:
    name: str
    args: list


@dataclass
class Text:
    value: str


@dataclass
class Emit:
    expr: Any


@dataclass
class If:
    branches: list  # (condition or None, nodes)


@dataclass
class For:
    var: str
    over: Any
    body: list


@dataclass
class Generation:
    body: list


class _Expr:
    """Recursive descent over the words of one expression."""

    def __init__(self, source: str):
        self.words, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = WORD.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def whole(self) -> Any:
        e = self.either()
        if self.at != len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return e

    def either(self) -> Any:
        e = self.both()
        while self.take("or"):
            e = Op("or", [e, self.both()])
        return e

    def both(self) -> Any:
        e = self.negated()
        while self.take("and"):
            e = Op("and", [e, self.negated()])
        return e

    def negated(self) -> Any:
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Any:
        e = self.joined()
        while kind := self.take("==", "!=", "in"):
            e = Op(kind, [e, self.joined()])
        return e

    def joined(self) -> Any:
        e = self.filtered()
        while kind := self.take("+", "~"):
            e = Op(kind, [e, self.filtered()])
        return e

    def filtered(self) -> Any:
        e = self.atom()
        while self.take("|"):
            kind, name = self.words[self.at] if self.at < len(self.words) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            args = []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    if not self.take(",") and self.peek() != ")":
                        raise TemplateError("expected , or )")
            e = Filter(name, [e, *args])
        return e

    def atom(self) -> Any:
        if self.take("("):
            e = self.either()
            if not self.take(")"):
                raise TemplateError("expected )")
            return e
        if self.at >= len(self.words):
            raise TemplateError("an expression is missing")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(word))
        if kind == "name":
            if word in ("true", "false", "none"):
                return Const({"true": True, "false": False, "none": None}[word])
            path = [word]
            while self.take("."):
                kind, part = self.words[self.at] if self.at < len(self.words) else ("", "")
                if kind != "name" or part.startswith("_"):
                    raise TemplateError("expected a field name")
                self.at += 1
                path.append(part)
            return Name(tuple(path))
        raise TemplateError(f"unexpected {word!r}")


def parse(source: str) -> list:
    pieces, at = [], 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("emit", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pieces.reverse()

    def block(ends: tuple[str, ...]) -> tuple[list, str]:
        nodes: list = []
        while pieces:
            kind, s = pieces.pop()
            if kind == "text":
                nodes.append(Text(s))
            elif kind == "emit":
                nodes.append(Emit(_Expr(s).whole()))
            else:
                word, _, rest = s.partition(" ")
                if word in ends:
                    return nodes, s
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad loop {s!r}")
                    nodes.append(For(m[1], _Expr(m[2]).whole(), block(("endfor",))[0]))
                elif word == "if":
                    branches, condition = [], _Expr(rest).whole()
                    while True:
                        body, end = block(("elif", "else", "endif"))
                        branches.append((condition, body))
                        if end == "endif":
                            break
                        if end == "else":
                            branches.append((None, block(("endif",))[0]))
                            break
                        condition = _Expr(end[4:]).whole()
                    nodes.append(If(branches))
                elif word == "generation":
                    nodes.append(Generation(block(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown tag {s!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return block(())[0]


_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: _show(a) + _show(b), "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _show(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def fold(node: Any) -> Any:
    """Constants first: an operation or filter of constants becomes its value."""
    if isinstance(node, (Op, Filter)):
        args = [fold(a) for a in node.args]
        if all(isinstance(a, Const) for a in args):
            f = _OPS[node.kind] if isinstance(node, Op) else FILTERS[node.name]
            return Const(f(*[a.value for a in args]))
        if isinstance(node, Op) and node.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        return Op(node.kind, args) if isinstance(node, Op) else Filter(node.name, args)
    return node


def fold_nodes(nodes: list) -> list:
    out: list = []
    for n in nodes:
        if isinstance(n, Emit):
            e = fold(n.expr)
            n = Text(_show(e.value)) if isinstance(e, Const) else Emit(e)
        elif isinstance(n, If):
            branches = []
            for c, body in n.branches:
                c = None if c is None else fold(c)
                if isinstance(c, Const):
                    if not c.value:
                        continue
                    c = None
                branches.append((c, fold_nodes(body)))
                if c is None:
                    break
            if branches and branches[0][0] is None:
                for x in branches[0][1]:
                    _add(out, x)
                continue
            if not branches:
                continue
            n = If(branches)
        elif isinstance(n, For):
            n = For(n.var, fold(n.over), fold_nodes(n.body))
        elif isinstance(n, Generation):
            n = Generation(fold_nodes(n.body))
        _add(out, n)
    return out


def _add(out: list, n: Any) -> None:
    if isinstance(n, Text) and not n.value:
        return
    if isinstance(n, Text) and out and isinstance(out[-1], Text):
        out[-1] = Text(out[-1].value + n.value)
    else:
        out.append(n)


# --- closures


@dataclass
class Sink:
    """What a template writes: pieces of text, and spans of code points under generation markers."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.size += len(s)


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        v = e.value
        return lambda env: v
    if isinstance(e, Name):
        first, rest = e.path[0], e.path[1:]
        if not rest:
            return lambda env: env.get(first)
        if len(rest) == 1:
            one = rest[0]
            return lambda env: (env.get(first) or {}).get(one)

        def deep(env: dict) -> Any:
            v = env.get(first)
            for p in rest:
                v = v.get(p) if isinstance(v, dict) else None
            return v

        return deep
    args = [_value(a) for a in e.args]
    if isinstance(e, Filter):
        f = FILTERS[e.name]
        if len(args) == 1:
            (a,) = args
            return lambda env: f(a(env))
        if e.name == "escape" and all(isinstance(x, Const) for x in e.args[1:]):
            a, controls = args[0], tuple(x.value for x in e.args[1:])
            sub = _escaper(controls).sub
            return lambda env: sub(lambda m: "\\" + m[0], _show(a(env)))
        return lambda env: f(*[a(env) for a in args])
    a = args[0]
    if e.kind == "not":
        return lambda env: not a(env)
    b = args[1]
    if e.kind == "and":
        return lambda env: a(env) and b(env)
    if e.kind == "or":
        return lambda env: a(env) or b(env)
    f = _OPS[e.kind]
    return lambda env: f(a(env), b(env))


def _closure(nodes: list) -> Callable[[dict, Sink], None]:
    steps: list[Callable[[dict, Sink], None]] = []
    for n in nodes:
        if isinstance(n, Text):
            steps.append(lambda env, sink, s=n.value: sink.write(s))
        elif isinstance(n, Emit):
            steps.append(lambda env, sink, v=_value(n.expr): sink.write(_show(v(env))))
        elif isinstance(n, If):
            branches = [((lambda env: True) if c is None else _value(c), _closure(body)) for c, body in n.branches]

            def choose(env: dict, sink: Sink, branches: list = branches) -> None:
                for c, body in branches:
                    if c(env):
                        body(env, sink)
                        return

            steps.append(choose)
        elif isinstance(n, Generation):

            def mark(env: dict, sink: Sink, body: Callable = _closure(n.body)) -> None:
                at = sink.size
                body(env, sink)
                sink.spans.append((at, sink.size))

            steps.append(mark)
        else:

            def loop(env: dict, sink: Sink, var: str = n.var, over: Callable = _value(n.over), body: Callable = _closure(n.body)) -> None:
                items = over(env) or []
                inner = dict(env)
                last = len(items) - 1 if hasattr(items, "__len__") else None
                for i, x in enumerate(items):
                    inner[var] = x
                    inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == last}
                    body(inner, sink)

            steps.append(loop)
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, sink: Sink) -> None:
        for s in steps:
            s(env, sink)

    return run


def _names(node: Any) -> Iterable[str]:
    if isinstance(node, Name):
        yield node.path[0]
    elif isinstance(node, (Op, Filter)):
        for a in node.args:
            yield from _names(a)
    elif isinstance(node, Emit):
        yield from _names(node.expr)
    elif isinstance(node, If):
        for c, body in node.branches:
            if c is not None:
                yield from _names(c)
            for x in body:
                yield from _names(x)
    elif isinstance(node, (For, Generation)):
        if isinstance(node, For):
            yield from _names(node.over)
        for x in node.body:
            yield from _names(x)


class Template:
    def __init__(self, source: str):
        self.tree = fold_nodes(parse(source))
        self._run = _closure(self.tree)

    @property
    def turn_local(self) -> bool:
        """Whether the output of a list of messages is the outputs of its parts joined."""
        if len(self.tree) != 1 or not isinstance(self.tree[0], For) or self.tree[0].over != Name(("messages",)):
            return False
        return not {"loop", "messages"} & {x for n in self.tree[0].body for x in _names(n)}

    def render(self, messages: list[dict], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans under generation markers in code points)."""
        sink = Sink()
        self._run({**names, "messages": messages}, sink)
        return "".join(sink.parts), sink.spans


# --- the production format: marks around turns, control strings escaped

HEAD, COLON, END = "### ", ": ", " </turn>\n"
TEXT_CONTROLS = ("### ", "</turn>")
ROLE_CONTROLS = ("### ", "</turn>", ": ")
SOURCE = "{% for m in messages %}### {{ m.role | escape('### ', '</turn>', ': ') }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape('### ', '</turn>') }}{% endgeneration %}{% else %}{{ m.text | escape('### ', '</turn>') }}{% endif %} </turn>\n{% endfor %}"
_TURN = re.compile(r"### ((?:\\.|(?!: )[^\\])*): ((?:\\.|(?! </turn>\n)[^\\])*) </turn>\n", re.S)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn, from the formatted text alone."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 40]!r}")
        yield unescape(m[1], ROLE_CONTROLS), unescape(m[2], TEXT_CONTROLS)
        at = m.end()


class _Digest:
    """Running values of one conversation, fed in order."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, n: int, turns: bytes, loss_chars: int, loss: bytes, chars: int) -> None:
        self.turns, self.loss, self.chars = self.turns + n, self.loss + loss_chars, self.chars + chars
        self.turn_hash.update(turns)
        self.loss_hash.update(loss)

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _measure(template: Template, messages: list[dict]) -> tuple[int, bytes, int, bytes, int]:
    """A run of turns: formatted, then read back from the output and its spans."""
    text, spans = template.render(messages)
    turns = list(read_back(text))
    loss = "".join(unescape(text[a:b], TEXT_CONTROLS) for a, b in spans)
    return len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), len(loss), loss.encode(), len(text)


def format_conversations(rows: DataFrame, source: str = SOURCE, parts: int | None = None) -> DataFrame:
    """One row a conversation with the digests of its formatted text, read back."""
    from taxaflow.llm.common import parts_for

    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or parts_for(rows, 4 << 20)
    key = ["conv_id", "turn", "role", "text"]
    local = Template(source).turn_local
    piece = "conv_id long, final boolean, seq long, n long, turns binary, loss_chars long, loss binary, chars long, turns_sha256 string, loss_sha256 string"

    def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int | None, list[dict], bool]]:
        """(conv_id, messages, whether the conversation's rows end here), at most `most` characters at a time."""
        conv, held, size, any_ = None, [], 0, False
        for batch in batches:
            c, r, t = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i in range(len(c)):
                if any_ and c[i] != conv:
                    yield conv, held, True
                    held, size = [], 0
                elif size > most:
                    yield conv, held, False
                    held, size = [], 0
                conv, any_ = c[i], True
                held.append({"role": r[i], "text": t[i]})
                size += len(t[i])
        if any_:
            yield conv, held, True

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        template, part = Template(source), TaskContext.get().partitionId()
        out: list[tuple] = []
        seq, first, inside, waiting = 0, True, False, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in piece.split(", ")])
            out.clear()
            return made

        # The first and the last conversation of a partition may go on in its neighbours: they leave as parts. Those
        # between are whole. A run of the last one can't be told from a run of one between until its end, so a long
        # conversation between leaves as parts too, and is finished in the second step.
        for conv, messages, ends in runs(batches, 1 << 20):
            values = _measure(template, messages)
            n, turns, lc, loss, chars = values
            if waiting is not None:  # it has ended, and another conversation follows
                d = _Digest()
                d.add(*waiting[1])
                c, m, x, lx, y, cx = d.row(waiting[0])
                out.append((c, True, 0, m, None, lx, None, cx, x, y))
                waiting = None
            if ends and not first and not inside:
                waiting = (conv, values)
            else:
                out.append((conv, False, part << 32 | seq, n, turns, lc, loss, chars, None, None))
                seq += 1
            inside = not ends
            first = first and not ends
            if len(out) >= 500 or not ends:
                yield flush()
        if waiting is not None:
            n, turns, lc, loss, chars = waiting[1]
            out.append((waiting[0], False, part << 32 | seq, n, turns, lc, loss, chars, None, None))
        if out:
            yield flush()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, done = Template(source), []
        for conv, messages, _ in runs(batches, 1 << 62):
            d = _Digest()
            d.add(*_measure(template, messages))
            done.append(d.row(conv))
            if len(done) >= 2000:
                yield _result(done)
                done = []
        if done:
            yield _result(done)

    if not local:
        return rows.repartition(parts, "conv_id").sortWithinPartitions(*key).mapInArrow(whole, RESULT)
    pieces = rows.repartitionByRange(parts, *key[:2]).sortWithinPartitions(*key).mapInArrow(by_range, piece)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, digest = [], None, None
        for batch in batches:
            for c, final, _, n, turns, lc, loss, chars, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if final:
                    done.append((c, n, a, lc, b, chars))
                else:
                    if digest is not None and c != conv:
                        done.append(digest.row(conv))
                        digest = None
                    conv, digest = c, digest or _Digest()
                    digest.add(n, turns, lc, loss, chars)
            if len(done) >= 2000:
                yield _result(done)
                done = []
        if digest is not None:
            done.append(digest.row(conv))
        if done:
            yield _result(done)

    # only conversations at the edges of partitions are parts here; they are few unless long
    return pieces.repartition(parts, "conv_id").sortWithinPartitions("final", "conv_id", "seq").mapInArrow(join, RESULT)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])
