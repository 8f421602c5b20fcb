"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}`` and ``{% statement %}`` parts. It is parsed into a syntax tree, constants
are folded (and text next to text joined), and the tree becomes nested Python closures that append pieces to an output.
The language is a sandbox: literals, variables, fields of the current message, comparison, ``and or not in``, ``+``,
``~`` (join as text), filters from a fixed list, ``if``, ``for`` over the messages, ``set`` and ``generation``. There are
no calls, no attributes of Python objects and no other loops, so rendering ends and reaches nothing outside.
``{% generation %}`` marks the output that a model learns from; the output keeps the marked spans.

A template whose body looks at one message at a time is rendered where the rows are: nothing is gathered. A conversation
is then the sequence of its turns, so that a very long one spreads over tasks by ranges of (conversation, turn), each
task joins its turns into pieces of bounded size, and only pieces meet where a digest has to run in order. Other templates (``loop``, ``set``
across turns, text outside the loop) are rendered by ``render`` on one conversation's messages.

Null role or text is empty; null turns come first; rows alike are turns of their own; rows with the same turn follow role
and text; rows with a null conversation form one conversation with a null id; an empty table gives an empty table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import arrow_batch, arrow_fields, map_rows

#: Marks of turns. Escaped texts hold none of them.
TURN_OPEN, HEAD_END, TURN_CLOSE = "### ", ":\n", "</turn>\n"
#: The template of the registered query.
TEMPLATE = (
    "{% for message in messages %}{{ '### ' + message.role | escape_head }}:\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
#: Bytes that a piece of a conversation holds before the next one starts.
PIECE = 1 << 18


class TemplateError(ValueError):
    """The template does not parse, or asks for something outside the sandbox."""


def escape(text: str) -> str:
    """No control string is left: backslashes are doubled, and one parts ``###`` from its space and ``<`` from ``/turn>``."""
    return text.replace("\\", "\\\\").replace("### ", "###\\ ").replace("</turn>", "<\\/turn>")


def escape_head(text: str) -> str:
    return escape(text).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "escape_head": lambda v: escape_head(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, str | list) else 0,
}


def _text(value: Any) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


# ---- lexer and parser: tuples (kind, ...) ----

_PART = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|[-+~|.\[\](),<>%=]))", re.S)
_LOOP_FIELDS = ("index", "index0", "first", "last")


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m or m.end() == at:
            raise TemplateError(f"unexpected {code[at:at + 10]!r}")
        out.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing: or, and, not, comparison, + ~, filter, value."""

    def __init__(self, code: str):
        self.tokens, self.at = _tokens(code), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind != "string" and value in values:
            self.at += 1
            return value
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            return ("compare", op, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while op := self.take("+", "~", "%"):
            tree = ("join", op, tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.value()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def value(self) -> tuple:
        kind, value = self.peek()
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("expected )")
            return tree
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.either())
                self.take(",")
                if self.peek()[0] == "end":
                    raise TemplateError("expected ]")
            return ("list", *items)
        self.at += 1
        if kind == "string":
            named = {"n": "\n", "t": "\t", "r": "\r"}
            return ("constant", re.sub(r"\\(.)", lambda m: named.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("constant", int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value or 'end'!r}")
        if value in ("true", "false", "none", "True", "False", "None"):
            return ("constant", {"true": True, "false": False, "none": None}[value.lower()])
        tree: tuple = ("name", value)
        while True:
            if self.take("."):
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("expected a field name")
                self.at += 1
                tree = ("field", tree, name)
            elif self.take("["):
                kind, name = self.peek()
                if kind != "string":
                    raise TemplateError("expected a field name in quotes")
                self.at += 1
                if not self.take("]"):
                    raise TemplateError("expected ]")
                tree = ("field", tree, name[1:-1])
            else:
                return tree


_CLOSERS = {"for": ("endfor",), "if": ("elif", "else", "endif"), "else": ("endif",), "generation": ("endgeneration",)}


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(template):
        parts.append(("text", template[at : m.start()]))
        if m[1] is not None:
            parts.append(("show", m[1]))
        elif m[2] is not None:
            parts.append(("do", m[2].strip()))
        at = m.end()
    parts.append(("text", template[at:]))
    tree, rest, closer = _block(parts, 0, ())
    return tree


def _block(parts: list[tuple[str, str]], at: int, closers: tuple[str, ...]) -> tuple[tuple, int, str]:
    out: list[tuple] = []
    while at < len(parts):
        kind, code = parts[at]
        at += 1
        if kind == "text":
            out.append(("text", code))
        elif kind == "show":
            out.append(("show", _Expression(code).whole()))
        else:
            word = code.split(None, 1)[0] if code else ""
            rest = code[len(word) :].strip()
            if word in closers:
                return ("block", *out), at, code
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+messages", rest)
                if not m:
                    raise TemplateError("loops run over messages only")
                body, at, _ = _block(parts, at, _CLOSERS["for"])
                out.append(("for", m[1], body))
            elif word == "if":
                branches = []
                while True:
                    test = _Expression(rest).whole()
                    body, at, end = _block(parts, at, _CLOSERS["if"])
                    branches.append((test, body))
                    if end.startswith("elif"):
                        rest = end[4:].strip()
                        continue
                    other: tuple = ("block",)
                    if end == "else":
                        other, at, _ = _block(parts, at, _CLOSERS["else"])
                    break
                for test, body in reversed(branches):
                    other = ("if", test, body, other)
                out.append(other)
            elif word == "generation":
                body, at, _ = _block(parts, at, _CLOSERS["generation"])
                out.append(("generation", body))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.*)", rest, re.S)
                if not m or m[1] in ("messages", "loop"):
                    raise TemplateError(f"bad set {rest!r}")
                out.append(("set", m[1], _Expression(m[2]).whole()))
            else:
                raise TemplateError(f"no statement {word!r}")
    if closers:
        raise TemplateError(f"expected {closers[-1]}")
    return ("block", *out), at, ""


# ---- constant folding ----


def fold(tree: tuple) -> tuple:
    """The same template with constant expressions computed, decided branches taken and text joined."""
    kind = tree[0]
    if kind in ("text", "constant", "name"):
        return tree
    tree = tuple(fold(x) if isinstance(x, tuple) else x for x in tree)
    if kind == "block":
        out: list[tuple] = []
        for x in tree[1:]:
            for y in x[1:] if x[0] == "block" else (x,):
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("block", *out)
    if kind == "show":
        return ("text", _text(tree[1][1])) if tree[1][0] == "constant" else tree
    if kind == "if":
        return (tree[2] if tree[1][1] else tree[3]) if tree[1][0] == "constant" else tree
    if kind == "list":
        return ("constant", [x[1] for x in tree[1:]]) if all(x[0] == "constant" for x in tree[1:]) else tree
    if kind in ("filter", "not", "and", "or", "compare", "join") and all(x[0] == "constant" for x in tree[1:] if isinstance(x, tuple)):
        return ("constant", _value(tree)({}))
    return tree


# ---- closures ----


@dataclass
class Output:
    """Rendered pieces and the spans, in characters, that generation marks cover."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def _value(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "constant":
        constant = tree[1]
        return lambda scope: constant
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        of, name = _value(tree[1]), tree[2]
        return lambda scope: got.get(name) if isinstance(got := of(scope), dict) else None
    if kind == "filter":
        apply, of = FILTERS[tree[1]], _value(tree[2])
        return lambda scope: apply(of(scope))
    if kind == "list":
        items = [_value(x) for x in tree[1:]]
        return lambda scope: [f(scope) for f in items]
    if kind == "not":
        of = _value(tree[1])
        return lambda scope: not of(scope)
    if kind in ("and", "or"):
        a, b = _value(tree[1]), _value(tree[2])
        return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))
    op, a, b = tree[1], _value(tree[2]), _value(tree[3])
    if kind == "join":
        return lambda scope: _plus(op, a(scope), b(scope))
    return lambda scope: _compare(op, a(scope), b(scope))


def _plus(op: str, a: Any, b: Any) -> Any:
    if op == "%":
        return a % b if isinstance(a, int) and isinstance(b, int) and b else 0
    if op == "+" and isinstance(a, int) and isinstance(b, int):
        return a + b
    return _text(a) + _text(b)


def _compare(op: str, a: Any, b: Any) -> bool:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if op == "in":
        return a in b if isinstance(b, list) or isinstance(a, str) and isinstance(b, str) else False
    try:
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    except TypeError:
        return False


def _emit(tree: tuple) -> Callable[[dict, Output], None]:
    kind = tree[0]
    if kind == "block":
        steps = [_emit(x) for x in tree[1:]]

        def block(scope: dict, out: Output) -> None:
            for step in steps:
                step(scope, out)

        return block
    if kind == "text":
        text = tree[1]
        return lambda scope, out: out.put(text)
    if kind == "show":
        value = _value(tree[1])
        return lambda scope, out: out.put(_text(value(scope)))
    if kind == "set":
        name, value = tree[1], _value(tree[2])
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "if":
        test, yes, no = _value(tree[1]), _emit(tree[2]), _emit(tree[3])
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    body = _emit(tree[2] if kind == "for" else tree[1])
    if kind == "generation":

        def generation(scope: dict, out: Output) -> None:
            start = out.size
            body(scope, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return generation
    variable = tree[1]

    def loop(scope: dict, out: Output) -> None:
        messages = scope.get("messages") or []
        for k, message in enumerate(messages):
            scope[variable] = message
            scope["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(messages) - 1}
            body(scope, out)

    return loop


def _uses(tree: tuple, kind: str, name: str | None = None) -> bool:
    return tree[0] == kind and name in (None, tree[1]) or any(_uses(x, kind, name) for x in tree[1:] if isinstance(x, tuple))


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._render = _emit(self.tree)
        loops = [x for x in self.tree[1:] if x[0] == "for"]
        #: Whether a conversation's output is its turns' outputs, one after the other.
        self.by_turn = len(self.tree) == 2 and len(loops) == 1 and not any(_uses(self.tree, *x) for x in (("set",), ("name", "loop"), ("name", "messages")))

    def render(self, messages: list[dict[str, Any]]) -> Output:
        out = Output()
        self._render({"messages": messages}, out)
        return out


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """Turns (role, text) of an output of TEMPLATE's shape, and the unescaped text under its generation marks."""
    turns = []
    for part in formatted.split(TURN_CLOSE)[:-1]:
        role, _, text = part.removeprefix(TURN_OPEN).partition(HEAD_END)
        turns.append((unescape(role), unescape(text)))
    return turns, "".join(unescape(formatted[s:e]) for s, e in spans)


# ---- Spark ----


def render(rows: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """conv_id, turn, formatted, spans_from, spans_to of every row (conv_id, turn, role, text), for by-turn templates.

    Spans count characters from the start of the turn's output."""
    if not Template(source).by_turn:
        raise TemplateError("the template looks beyond one turn; call Template.render on whole conversations")

    def start():
        template = Template(source)

        def row(conv_id, turn, role, text):
            out = template.render([{"role": role or "", "text": text or ""}])
            return [(conv_id, turn, out.text, [s for s, _ in out.spans], [e for _, e in out.spans])]

        return row

    schema = "conv_id long, turn long, formatted string, spans_from array<int>, spans_to array<int>"
    return map_rows(rows.select("conv_id", "turn", "role", "text"), schema, start)


_PIECES = "conv_id long, part long, piece long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a task, read back and joined into pieces of one conversation each."""
    fields = arrow_fields(_PIECES)
    part, piece, now, n, chars, loss_chars, size = 0, 0, None, 0, 0, 0, 0
    turns: list[bytes] = []
    loss: list[bytes] = []
    done: list[tuple] = []
    for batch in batches:
        for part, conv_id, formatted, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
            if n and (conv_id != now or size >= PIECE):
                done.append((now, part, piece, n, b"".join(turns), b"".join(loss), loss_chars, chars))
                turns, loss, n, chars, loss_chars, size, piece = [], [], 0, 0, 0, 0, piece + 1
                if len(done) >= 64:
                    yield arrow_batch(fields, done)
                    done = []
            now = conv_id
            (role, text), learned = (got := read_back(formatted, list(zip(starts, ends, strict=True))))[0][0], got[1]
            turns.append(f"{role}\n{text}\n".encode())
            loss.append(learned.encode())
            n, chars, loss_chars, size = n + 1, chars + len(formatted), loss_chars + len(learned), size + len(formatted)
    if n:
        done.append((now, part, piece, n, b"".join(turns), b"".join(loss), loss_chars, chars))
    if done:
        yield arrow_batch(fields, done)


def _to_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their pieces in order; a task holds one piece at a time."""
    fields = arrow_fields(_DIGESTS)
    now, n, loss_chars, chars, turns, loss, any_row = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), False
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(c for c in batch.columns), strict=True):
            conv_id, _, _, k, t, x, lc, fc = (v.as_py() for v in row)
            if any_row and conv_id != now:
                out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                n, loss_chars, chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            now, any_row = conv_id, True
            n, loss_chars, chars = n + k, loss_chars + lc, chars + fc
            turns.update(t)
            loss.update(x)
        if out:
            yield arrow_batch(fields, out)
            out = []
    if any_row:
        yield arrow_batch(fields, [(now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])


def digests(rendered: DataFrame) -> DataFrame:
    """What reading back finds in rendered turns: conv_id, n_turns, digests of turns and of text under the loss mask."""
    spark = rendered.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "formatted"]
    ranged = rendered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = ranged.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "formatted", "spans_from", "spans_to")
    pieces = numbered.mapInArrow(_to_pieces, _PIECES)
    return pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_to_digests, _DIGESTS)
