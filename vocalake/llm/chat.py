"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that write a conversation and mark what a model is to generate:

    {% for turn in turns %} ... {% endfor %}      {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {{ turn.text | escape }}                      {% set name = expression %}
    {% generation %} ... {% endgeneration %}

Expressions have literals, names, fields of mappings, indices, + ~ == != < > <= >= in, and or not,
`a if b else c` and the filters below. There are no calls and no attributes of Python objects.
"""

from __future__ import annotations

import contextlib
import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalake.llm.common import mapped

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that steer a model or this format; inside texts they are escaped.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{% set start = '<|tu' + 'rn|>' %}"
    "{% for turn in turns %}{{ start }}{{ turn.role | escape }}<|text|>"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}<|end|>{% if not loop.last %}\n{% endif %}{% endfor %}"
)


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- escaping

_ESCAPED = re.compile("\\\\|" + "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """Doubles backslashes and sets one behind the first character of each control string."""
    return _ESCAPED.sub(lambda m: "\\\\" if m.group() == "\\" else m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# ---------------------------------------------------------------- tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Put:
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (test, body), the last test may be Const(True)


@dataclass(frozen=True)
class Assign:
    name: str
    of: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _joined(a: Any, b: Any) -> str:
    return _shown(a) + _shown(b)


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "+": operator.add, "~": _joined, "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt,
    "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b,
}
_FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_shown(v)), "trim": lambda v: _shown(v).strip(), "upper": lambda v: _shown(v).upper(),
    "lower": lambda v: _shown(v).lower(), "length": len, "string": _shown,
}

# ---------------------------------------------------------------- parser

_QUOTED = r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?"
#: An expression, a tag, or the begin of one that doesn't end; what is quoted may hold any signs.
_PARTS = re.compile(rf"\{{\{{({_QUOTED})\}}\}}|\{{%({_QUOTED})%\}}|(\{{[{{%])", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>.|()\[\]]))")
_CODES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        at, kind = m.end(), m.lastgroup
        value: Any = m.group(kind)
        if kind == "text":
            value = re.sub(r"\\(.)", lambda x: _CODES.get(x.group(1), x.group(1)), value[1:-1], flags=re.S)
        out.append((kind, int(value) if kind == "int" else value))
    return [*out, ("end", None)]


class _Expression:
    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, found {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        tree = self.choice()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> Any:
        yes = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Choice(test, yes, self.choice())
        return yes

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Binary("and", left, self.negated())
        return left

    def negated(self) -> Any:
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.sums()
        if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            return Binary(op, left, self.sums())
        return left

    def sums(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Binary(op, left, self.filtered())
        return left

    def filtered(self) -> Any:
        tree = self.atom()
        while op := self.take(".", "[", "|"):
            kind, value = self.tokens[self.at]
            if op == "[":
                tree = Item(tree, self.choice())
                self.need("]")
                continue
            if kind != "name":
                raise TemplateError(f"a name expected after {op!r}")
            self.at += 1
            if op == "|" and value not in _FILTERS:
                raise TemplateError(f"no filter {value!r}")
            tree = Filter(value, tree) if op == "|" else Item(tree, Const(value))
        return tree

    def atom(self) -> Any:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        minus = self.take("-")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(-value if minus else value)
        if minus or kind not in ("text", "name"):
            raise TemplateError(f"unexpected {value!r}")
        if kind == "text":
            return Const(value)
        return Const({"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Name(value)


class _Parser:
    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in _PARTS.finditer(source):
            if m.group(3):
                raise TemplateError(f"{source[m.start():m.start() + 20]!r} does not end")
            self.parts += [("text", source[at : m.start()])] * (m.start() > at)
            self.parts.append(("put", m.group(1)) if m.group(1) is not None else ("tag", m.group(2).strip()))
            at = m.end()
        self.parts += [("text", source[at:])] * (len(source) > at)
        self.at = 0

    def block(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag that begins with one of the ends, and that tag."""
        nodes: list[Any] = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            word, _, rest = body.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "text":
                nodes.append(Put(Const(body)))
            elif kind == "put":
                nodes.append(Put(_Expression(body).whole()))
            elif word in ends:
                return tuple(nodes), body
            elif word == "for":
                name, found, of = rest.partition(" in ")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"bad loop {body!r}")
                nodes.append(For(name.strip(), _Expression(of).whole(), self.block("endfor")[0]))
            elif word == "if":
                branches, test = [], _Expression(rest).whole()
                while True:
                    inner, tag = self.block("elif", "else", "endif")
                    branches.append((test, inner))
                    if tag == "endif":
                        break
                    test = Const(True) if tag == "else" else _Expression(tag.partition(" ")[2]).whole()
                nodes.append(If(tuple(branches)))
            elif word == "set":
                name, found, of = rest.partition("=")
                if not found or not name.strip().isidentifier():
                    raise TemplateError(f"bad assignment {body!r}")
                nodes.append(Assign(name.strip(), _Expression(of).whole()))
            elif word == "generation":
                nodes.append(Generation(self.block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""


@contextlib.contextmanager
def _errors() -> Iterator[None]:
    """Whatever goes wrong in a template is a TemplateError."""
    try:
        yield
    except TemplateError:
        raise
    except (TypeError, ValueError, LookupError, ArithmeticError, RecursionError) as error:
        raise TemplateError(f"{type(error).__name__}: {error}") from None


def parse(source: str) -> tuple:
    with _errors():
        return _Parser(source).block()[0]


# ---------------------------------------------------------------- folding


def _names_set(nodes: tuple) -> list[str]:
    """Names that are assigned or looped over anywhere, as often as they are."""
    out: list[str] = []
    for n in nodes:
        if isinstance(n, Assign | For):
            out.append(n.name)
        if isinstance(n, For | Generation):
            out += _names_set(n.body)
        if isinstance(n, If):
            for _, body in n.branches:
                out += _names_set(body)
    return out


def fold(nodes: tuple) -> tuple:
    """The tree with constant expressions evaluated, names that only ever get one constant at the top
    put in place, dead branches gone and neighbouring texts joined."""
    once = _names_set(nodes)
    return _fold(nodes, {}, {n for n in once if once.count(n) == 1})


def _fold(nodes: tuple, known: dict[str, Any], once: set[str]) -> tuple:
    out: list[Any] = []
    for node in nodes:
        if isinstance(node, Assign):
            of = _folded(node.of, known)
            if isinstance(of, Const) and node.name in once and known is not None:
                known[node.name] = of
                continue
            out.append(Assign(node.name, of))
        elif isinstance(node, Put):
            of = _folded(node.of, known)
            if isinstance(of, Const):
                of = Const(_shown(of.value))
                if out and isinstance(out[-1], Put) and isinstance(out[-1].of, Const):
                    of = Const(out.pop().of.value + of.value)
            out.append(Put(of))
        elif isinstance(node, For):
            inside = {k: v for k, v in known.items() if k not in (node.name, "loop")}  # the loop has these names itself
            out.append(For(node.name, _folded(node.of, known), _fold(node.body, inside, set())))
        elif isinstance(node, Generation):
            out.append(Generation(_fold(node.body, dict(known), set())))
        else:
            branches: list[tuple] = []
            for test, body in node.branches:
                test = _folded(test, known)
                if isinstance(test, Const) and not test.value:
                    continue
                branches.append((test, _fold(body, dict(known), set())))
                if isinstance(test, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                out += _fold(branches[0][1], known, set())
            elif branches:
                out.append(If(tuple(branches)))
    return tuple(n for n in out if not (isinstance(n, Put) and n.of == Const("")))


def _folded(tree: Any, known: dict[str, Any]) -> Any:
    if isinstance(tree, Name):
        return known.get(tree.name, tree)
    if isinstance(tree, Item):
        return Item(_folded(tree.of, known), _folded(tree.key, known))
    if isinstance(tree, Filter):
        of = _folded(tree.of, known)
        return _made(_FILTERS[tree.name], of) or Filter(tree.name, of)
    if isinstance(tree, Not):
        of = _folded(tree.of, known)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(tree, Choice):
        test = _folded(tree.test, known)
        if isinstance(test, Const):
            return _folded(tree.yes if test.value else tree.no, known)
        return Choice(test, _folded(tree.yes, known), _folded(tree.no, known))
    if isinstance(tree, Binary):
        left, right = _folded(tree.left, known), _folded(tree.right, known)
        if tree.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (tree.op == "and") else left
        return _made(_OPS.get(tree.op), left, right) or Binary(tree.op, left, right)
    return tree


def _made(use: Callable | None, *trees: Any) -> Const | None:
    """What a function makes of constants; nothing where it fails, so that this is an error only if it is reached."""
    if use and all(isinstance(t, Const) for t in trees):
        with contextlib.suppress(Exception):
            return Const(use(*(t.value for t in trees)))
    return None


# ---------------------------------------------------------------- closures


class _Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


Scope = dict[str, Any]


def _value(tree: Any) -> Callable[[Scope], Any]:
    if isinstance(tree, Const):
        return lambda scope, v=tree.value: v
    if isinstance(tree, Name):
        def look(scope: Scope, name: str = tree.name) -> Any:
            if name not in scope:
                raise TemplateError(f"{name!r} is not defined")
            return scope[name]
        return look
    if isinstance(tree, Item):
        of, key = _value(tree.of), _value(tree.key)

        def item(scope: Scope) -> Any:
            whole, k = of(scope), key(scope)
            if isinstance(whole, dict):
                return whole.get(k)
            if isinstance(whole, list | str) and isinstance(k, int):
                return whole[k]
            raise TemplateError(f"no field {k!r}")

        return item
    if isinstance(tree, Filter):
        of, use = _value(tree.of), _FILTERS[tree.name]
        return lambda scope: use(of(scope))
    if isinstance(tree, Not):
        of = _value(tree.of)
        return lambda scope: not of(scope)
    if isinstance(tree, Choice):
        test, yes, no = _value(tree.test), _value(tree.yes), _value(tree.no)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    left, right = _value(tree.left), _value(tree.right)
    if tree.op == "and":
        return lambda scope: left(scope) and right(scope)
    if tree.op == "or":
        return lambda scope: left(scope) or right(scope)
    use2 = _OPS[tree.op]
    return lambda scope: use2(left(scope), right(scope))


def _writer(nodes: tuple) -> Callable[[Scope, _Output], None]:
    steps = [_step(n) for n in nodes]

    def run(scope: Scope, out: _Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: Any) -> Callable[[Scope, _Output], None]:
    if isinstance(node, Put):
        if isinstance(node.of, Const):
            return lambda scope, out, text=_shown(node.of.value): out.put(text)
        of = _value(node.of)
        return lambda scope, out: out.put(_shown(of(scope)))
    if isinstance(node, Assign):
        of, name = _value(node.of), node.name

        def assign(scope: Scope, out: _Output) -> None:
            scope[name] = of(scope)

        return assign
    if isinstance(node, For):
        of, name, body = _value(node.of), node.name, _writer(node.body)

        def loop(scope: Scope, out: _Output) -> None:
            rows = list(of(scope))
            for k, row in enumerate(rows):
                loop_ = {"index0": k, "index": k + 1, "first": k == 0, "last": k == len(rows) - 1, "length": len(rows)}
                body(scope | {name: row, "loop": loop_}, out)

        return loop
    if isinstance(node, Generation):
        body = _writer(node.body)

        def marked(scope: Scope, out: _Output) -> None:
            start = out.size
            body(scope, out)
            out.spans.append((start, out.size))

        return marked
    branches = [(_value(test), _writer(body)) for test, body in node.branches]

    def choose(scope: Scope, out: _Output) -> None:
        for test, body in branches:
            if test(scope):
                body(scope, out)
                return

    return choose


Rendered = tuple[str, list[tuple[int, int]]]


def compiled(source: str) -> Callable[..., Rendered]:
    """A function of the template's variables to (text, spans under the loss mask); both raise nothing but TemplateError."""
    with _errors():
        write = _writer(fold(parse(source)))

    def render(**variables: Any) -> Rendered:
        out = _Output()
        with _errors():
            write(dict(variables), out)
        return "".join(out.parts), out.spans

    return render


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text written by TEMPLATE."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        middle = text.index(TEXT, at)
        end = text.index(END, middle)
        turns.append((unescape(text[at + len(TURN) : middle]), unescape(text[middle + len(TEXT) : end])))
        at = end + len(END)
        at += text.startswith("\n", at)
    return turns


# ---------------------------------------------------------------- the operator


def formatted(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans): each conversation rendered, spans being the loss mask's (start, end).

    rows: (conv_id, turn, role, text). Turns are in the order of turn, nulls first, ties by role and
    text; repeated rows are turns of their own. Null roles and texts are empty. Rows without conv_id
    are one conversation. A conversation is one text and so meets in one row, however long. An empty table
    gives an empty table; columns beyond these are not looked at, whatever their names.
    """
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in source:
            texts, spans = [], []
            for own in batch.column(1).to_pylist():
                text, marked = render(turns=own)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in marked])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, spans_type)], ["conv_id", "formatted", "spans"])

    return mapped(turns.select("conv_id", "turns"), batches, f"conv_id {kind}, formatted string, spans array<struct<start:bigint,end:bigint>>")


def digests(done: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted texts."""
    kind = done.schema["conv_id"].dataType.simpleString()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                row = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names)

    return mapped(done, batches, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
