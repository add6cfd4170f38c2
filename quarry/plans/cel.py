"""A small typed expression language (CEL's grammar and standard semantics) compiled to Spark columns.

An evaluation error is a NULL: Spark's three-valued AND and OR absorb it just as
the language does, and a filter drops it.  So division, conversion and indexing
compile to their try_ forms, and a conditional has no branch for an erroneous
condition.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions import scalars


class ExpressionError(ValueError):
    """The expression does not parse, names something unknown, or mixes types."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
    |(?P<float>(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?))
    |(?P<int>0[xX][0-9a-fA-F]+[uU]?|\d+[uU]?)
    |(?P<str>[rRbB]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%<>!?:.,()\[\]{}])""",
    re.X | re.S,
)
_RELATIONS = ("==", "!=", "<=", ">=", "<", ">", "in")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_MACROS = ("all", "exists", "exists_one", "map", "filter")


@dataclass
class Node:
    kind: str
    value: object = None
    args: tuple = ()


def _unquote(text: str) -> str:
    mode = text[: len(text) - len(text.lstrip("rRbB"))].lower()
    if "b" in mode:
        raise ExpressionError("bytes have no use here: no variable holds them")
    body = text[len(mode) :]
    n = 3 if body[:3] in ('"""', "'''") else 1
    body = body[n:-n]
    if "r" in mode:
        return body

    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "xXuU" else chr(int(x, 8)) if x[0].isdigit() else _ESCAPES.get(x, x)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|X[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", one, body, flags=re.S)


class Parser:
    """Precedence climbing: ?: then || && relations + - * / % unary and members."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"cannot read {text[at : at + 10]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else ""

    def take(self, *values: str) -> str | None:
        if self.peek() in values and self.peek():
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ExpressionError(f"expected {value!r}, found {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'!r}")

    def parse(self) -> Node:
        node = self.conditional()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def conditional(self) -> Node:
        node = self.chain(0)
        if self.take("?"):
            yes = self.chain(0)
            self.need(":")
            return Node("if", None, (node, yes, self.conditional()))
        return node

    _LEVELS = (("||",), ("&&",), _RELATIONS, ("+", "-"), ("*", "/", "%"))

    def chain(self, level: int) -> Node:
        if level == len(self._LEVELS):
            return self.unary()
        node = self.chain(level + 1)
        while op := self.take(*self._LEVELS[level]):
            node = Node("op", op, (node, self.chain(level + 1)))
        return node

    def unary(self) -> Node:
        if op := self.take("!", "-"):
            return Node("unary", op, (self.unary(),))
        return self.member()

    def member(self) -> Node:
        node = self.primary()
        while True:
            if self.take("."):
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    raise ExpressionError("a name must follow '.'")
                name = self.tokens[self.at][1]
                self.at += 1
                node = Node("call", name, (node, *self.arguments())) if self.take("(") else Node("field", name, (node,))
            elif self.take("["):
                node = Node("index", None, (node, self.conditional()))
                self.need("]")
            else:
                return node

    def arguments(self, end: str = ")") -> tuple:
        out = []
        if self.take(end):
            return ()
        while True:
            out.append(self.conditional())
            if self.take(end):
                return tuple(out)
            self.need(",")

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise ExpressionError("the expression ends too soon")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "float":
            return Node("lit", ("double", float(text)))
        if kind == "int":
            if text[-1] in "uU":
                raise ExpressionError("unsigned numbers have no use here: no variable holds them")
            return Node("lit", ("int", int(text, 0) if text[:2].lower() == "0x" else int(text)))
        if kind == "str":
            return Node("lit", ("string", _unquote(text)))
        if text == "(":
            node = self.conditional()
            self.need(")")
            return node
        if text == "[":
            return Node("list", None, self.arguments("]"))
        if text == "{":
            items = []
            while not self.take("}"):
                key = self.conditional()
                self.need(":")
                items += [key, self.conditional()]
                if not self.take(",") and self.peek() != "}":
                    raise ExpressionError("expected ',' or '}'")
            return Node("maplit", None, tuple(items))
        if kind == "name":
            if text in ("true", "false"):
                return Node("lit", ("bool", text == "true"))
            if text == "null":
                return Node("lit", ("null", None))
            if self.take("("):
                return Node("fn", text, self.arguments())
            return Node("name", text)
        raise ExpressionError(f"unexpected {text!r}")


def parse(text: str) -> Node:
    return Parser(text).parse() if text and text.strip() else Node("lit", ("bool", True))


@dataclass
class Typed:
    kind: str
    column: Column
    constant: object = None


_NUMBERS = ("int", "double")
_ACCESSORS: dict[str, Callable[[Column], Column]] = {
    "getFullYear": F.year,
    "getMonth": lambda c: F.month(c) - 1,
    "getDate": F.dayofmonth,
    "getDayOfMonth": lambda c: F.dayofmonth(c) - 1,
    "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1,
    "getHours": F.hour,
    "getMinutes": F.minute,
    "getSeconds": F.second,
    "getMilliseconds": lambda c: F.floor(F.date_format(c, "SSS").cast("int")),
}


def re2(pattern: str) -> str:
    """*pattern* in Java's syntax; what RE2 does not have is an error."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern) or re.search(r"[*+?}]\+", pattern):
        raise ExpressionError(f"look-around, back references and possessive repeats are not RE2: {pattern!r}")
    return re.sub(r"\(\?P<", "(?<", pattern)


def _element(kind: str) -> str:
    return kind[5:-1] if kind.startswith("list<") else "dyn"


class Compiler:
    """Types and compiles one expression against *variables*: name -> (type, column)."""

    def __init__(self, variables: dict[str, tuple[str, Column]]):
        self.variables = variables
        self.used_variables: set[str] = set()
        self.used_functions: set[str] = set()

    def compile(self, node: Node, scope: dict[str, Typed] | None = None) -> Typed:
        return getattr(self, f"_{node.kind}")(node, scope or {})

    def _lit(self, node, scope) -> Typed:
        kind, value = node.value
        if kind == "int" and not -(1 << 63) <= value < 1 << 63:
            raise ExpressionError(f"{value} is out of range")
        column = F.lit(value).cast("bigint") if kind == "int" else F.lit(value)
        return Typed(kind, column, value)

    def _name(self, node, scope) -> Typed:
        if node.value in scope:
            return scope[node.value]
        if node.value not in self.variables:
            near = difflib.get_close_matches(node.value, self.variables, 1)
            raise ExpressionError(f"undeclared reference to {node.value!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        self.used_variables.add(node.value)
        return Typed(*self.variables[node.value])

    def _if(self, node, scope) -> Typed:
        test, yes, no = (self.compile(x, scope) for x in node.args)
        self._want(test, "bool", "?:")
        if yes.kind != no.kind:
            raise ExpressionError(f"branches differ: {yes.kind} and {no.kind}")
        return Typed(yes.kind, F.when(test.column, yes.column).when(~test.column, no.column))

    def _unary(self, node, scope) -> Typed:
        arg = node.args[0]
        if node.value == "-" and arg.kind == "lit" and arg.value[0] in _NUMBERS:
            return self._lit(Node("lit", (arg.value[0], -arg.value[1])), scope)
        x = self.compile(arg, scope)
        if node.value == "!":
            self._want(x, "bool", "!")
            return Typed("bool", ~x.column)
        if x.kind not in _NUMBERS:
            raise ExpressionError(f"no '-' for {x.kind}")
        return Typed(x.kind, F.try_subtract(F.lit(0).cast("bigint"), x.column) if x.kind == "int" else -x.column)

    def _want(self, x: Typed, kind: str, what: str) -> None:
        if x.kind not in (kind, "dyn"):
            raise ExpressionError(f"{what} takes {kind}, not {x.kind}")

    def _op(self, node, scope) -> Typed:
        op, (a, b) = node.value, (self.compile(x, scope) for x in node.args)
        if op in ("&&", "||"):
            self._want(a, "bool", op)
            self._want(b, "bool", op)
            return Typed("bool", a.column & b.column if op == "&&" else a.column | b.column)
        if op == "in":
            if b.kind == "map":
                self._want(a, "string", "in")
                return Typed("bool", F.array_contains(F.map_keys(F.try_variant_get(b.column, "$", "map<string,variant>")), a.column))
            if not b.kind.startswith("list<") or _element(b.kind) not in (a.kind, "dyn"):
                raise ExpressionError(f"no {a.kind} in {b.kind}")
            return Typed("bool", F.array_contains(b.column, a.column))
        if op in _RELATIONS:
            return Typed("bool", self._compare(op, a, b))
        return self._arithmetic(op, a, b)

    def _compare(self, op: str, a: Typed, b: Typed) -> Column:
        if "null" in (a.kind, b.kind):
            same = F.lit(a.kind == b.kind)
            return same if op == "==" else ~same
        if a.kind == "dyn" and b.kind in schema.SPARK_TYPES and b.kind != "map":
            a = Typed(b.kind, F.try_variant_get(a.column, "$", schema.SPARK_TYPES[b.kind].replace("timestamp_ntz", "timestamp")))
        elif b.kind == "dyn" and a.kind in schema.SPARK_TYPES and a.kind != "map":
            b = Typed(a.kind, F.try_variant_get(b.column, "$", schema.SPARK_TYPES[a.kind].replace("timestamp_ntz", "timestamp")))
        if a.kind != b.kind:
            raise ExpressionError(f"no {op!r} for {a.kind} and {b.kind}; convert one of them")
        if op not in ("==", "!=") and a.kind not in ("int", "double", "string", "timestamp", "duration", "bool"):
            raise ExpressionError(f"no {op!r} for {a.kind}")
        x, y = a.column, b.column
        out = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if a.kind == "double":  # a NaN is unlike any number
            nan = F.isnan(x) | F.isnan(y)
            out = (out | nan) if op == "!=" else (out & ~nan)
        return out

    def _arithmetic(self, op: str, a: Typed, b: Typed) -> Typed:
        pair = (a.kind, b.kind)
        if pair == ("int", "int"):
            fn = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)
            if fn:
                return Typed("int", fn(a.column, b.column))
            if op == "%":
                return Typed("int", F.when(b.column != 0, a.column % F.when(b.column != 0, b.column)))
            lowest = (a.column == F.lit(-(1 << 63)).cast("bigint")) & (b.column == -1)
            return Typed("int", F.when((b.column != 0) & ~lowest, _whole_divide(a.column, b.column)))
        if pair == ("double", "double") and op != "%":
            if op == "/":
                x, y = a.column, b.column
                inf = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
                return Typed("double", F.when(y == 0, inf).otherwise(F.try_divide(x, y)))
            return Typed("double", {"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column}[op])
        if pair == ("string", "string") and op == "+":
            return Typed("string", F.concat(a.column, b.column))
        if a.kind.startswith("list<") and pair[0] == pair[1] and op == "+":
            return Typed(a.kind, F.concat(a.column, b.column))
        if op in "+-" and pair in (("timestamp", "duration"), ("duration", "duration")):
            return Typed(a.kind, a.column + b.column if op == "+" else a.column - b.column)
        if op == "+" and pair == ("duration", "timestamp"):
            return Typed("timestamp", b.column + a.column)
        if op == "-" and pair == ("timestamp", "timestamp"):
            return Typed("duration", a.column - b.column)
        raise ExpressionError(f"no {op!r} for {a.kind} and {b.kind}")

    def _list(self, node, scope) -> Typed:
        items = [self.compile(x, scope) for x in node.args]
        kinds = {x.kind for x in items}
        if len(kinds) > 1:
            raise ExpressionError(f"a list of {' and '.join(sorted(kinds))}")
        if not items:
            return Typed("list<string>", F.array().cast("array<string>"))
        return Typed(f"list<{items[0].kind}>", F.array(*(x.column for x in items)), [x.constant for x in items])

    def _maplit(self, node, scope) -> Typed:
        items = [self.compile(x, scope) for x in node.args]
        return Typed("map", F.to_variant_object(F.create_map(*(x.column for x in items))) if items else F.parse_json(F.lit("{}")))

    def _field(self, node, scope) -> Typed:
        x = self.compile(node.args[0], scope)
        if x.kind not in ("map", "dyn"):
            raise ExpressionError(f"{x.kind} has no fields")
        return Typed("dyn", F.try_variant_get(x.column, "$." + node.value, "variant"))

    def _index(self, node, scope) -> Typed:
        x, at = (self.compile(n, scope) for n in node.args)
        if x.kind in ("map", "dyn") and isinstance(at.constant, str):
            return Typed("dyn", F.try_variant_get(x.column, f"$['{at.constant}']", "variant"))
        if x.kind.startswith("list<") and at.kind == "int":
            return Typed(_element(x.kind), F.when(at.column >= 0, F.get(x.column, at.column.cast("int"))))
        raise ExpressionError(f"no index {at.kind} for {x.kind}")

    def _call(self, node, scope) -> Typed:
        if node.value in _MACROS and len(node.args) in (3, 4) and node.args[1].kind == "name":
            return self._macro(node, scope)
        self.used_functions.add(node.value)
        x, *args = (self.compile(n, scope) for n in node.args)
        kinds = [a.kind for a in args]
        if node.value in ("contains", "startsWith", "endsWith", "matches") and x.kind in ("string", "dyn") and kinds == ["string"]:
            text = F.try_variant_get(x.column, "$", "string") if x.kind == "dyn" else x.column
            if node.value == "matches":
                if not isinstance(args[0].constant, str):
                    raise ExpressionError("matches() takes a literal pattern")
                return Typed("bool", F.rlike(text, F.lit(re2(args[0].constant))))
            return Typed("bool", {"contains": text.contains, "startsWith": text.startswith, "endsWith": text.endswith}[node.value](args[0].column))
        if node.value == "size" and not args:
            return self._size(x)
        if node.value in _ACCESSORS and x.kind == "timestamp":
            zone = args[0].constant if args else None
            when = F.convert_timezone(F.lit("UTC"), F.lit(zone), x.column) if zone else x.column
            return Typed("int", _ACCESSORS[node.value](when).cast("bigint"))
        if node.value in ("getHours", "getMinutes", "getSeconds", "getMilliseconds") and x.kind == "duration":
            seconds = _seconds(x.column)
            whole = {"getHours": seconds / 3600, "getMinutes": seconds / 60, "getSeconds": seconds, "getMilliseconds": seconds * 1000 % 1000}[node.value]
            return Typed("int", whole.cast("bigint"))
        raise ExpressionError(f"no {x.kind}.{node.value}({', '.join(kinds)})")

    def _macro(self, node, scope) -> Typed:
        over, var, *bodies = node.args
        x = self.compile(over, scope)
        if not x.kind.startswith("list<"):
            raise ExpressionError(f"{node.value}() goes over lists, not {x.kind}")
        kind = _element(x.kind)
        seen: dict[str, str] = {}

        def body(k):
            def run(c):
                t = self.compile(bodies[k], scope | {var.value: Typed(kind, c)})
                seen[str(k)] = t.kind
                return t.column

            return run

        if node.value == "map":
            items = F.filter(x.column, body(0)) if len(bodies) == 2 else x.column
            out = F.transform(items, body(len(bodies) - 1))
            return Typed(f"list<{seen[str(len(bodies) - 1)]}>", out)
        fn = body(0)
        column = {"all": F.forall, "exists": F.exists, "filter": F.filter, "exists_one": lambda c, f: F.size(F.filter(c, f)) == 1}[node.value](x.column, fn)
        if seen["0"] not in ("bool", "dyn"):
            raise ExpressionError(f"{node.value}() takes a test, not {seen['0']}")
        return Typed(x.kind if node.value == "filter" else "bool", column)

    def _size(self, x: Typed) -> Typed:
        if x.kind == "string":
            return Typed("int", F.char_length(x.column).cast("bigint"))
        if x.kind.startswith("list<"):
            return Typed("int", F.size(x.column).cast("bigint"))
        if x.kind == "map":
            return Typed("int", F.size(F.try_variant_get(x.column, "$", "map<string,variant>")).cast("bigint"))
        raise ExpressionError(f"no size of {x.kind}")

    def _fn(self, node, scope) -> Typed:
        name = node.value
        self.used_functions.add(name)
        if name == "has":
            if len(node.args) != 1 or node.args[0].kind != "field":
                raise ExpressionError("has() takes a field selection")
            return Typed("bool", self.compile(node.args[0], scope).column.isNotNull())
        args = [self.compile(x, scope) for x in node.args]
        kinds, columns = [a.kind for a in args], [a.column for a in args]
        if name == "size" and len(args) == 1:
            return self._size(args[0])
        if name in _CONVERSIONS and len(args) == 1:
            return _convert(name, args[0])
        if name == "type" and len(args) == 1:
            return Typed("string", F.lit(kinds[0]), kinds[0])
        if name == "dyn" and len(args) == 1:
            return args[0]
        if name == "levenshtein" and kinds == ["string", "string"]:
            return Typed("int", F.levenshtein(*columns).cast("bigint"))
        if name == "soundex" and kinds == ["string"]:
            return Typed("string", scalars.soundex(columns[0]))
        if name == "ngrams" and kinds == ["string", "int"]:
            return Typed("list<string>", scalars.ngrams(*columns))
        if name == "ngram_similarity" and kinds == ["string", "string", "int"]:
            return Typed("double", scalars.ngram_similarity(*columns))
        if name == "point_in_polygon" and len(args) == 3 and kinds[2] in ("list<double>", "list<int>") and set(kinds[:2]) <= set(_NUMBERS):
            return Typed("bool", scalars.point_in_polygon(columns[0].cast("double"), columns[1].cast("double"), columns[2].cast("array<double>")))
        if name == "image_similar_to" and kinds[:1] == ["string"] and len(args) == 2 and kinds[1] in _NUMBERS and "phash" in self.variables:
            return Typed("bool", scalars.similar_hash(self.variables["phash"][1], args[0].column, args[1].column.cast("double")))
        if name in ("has_secrets", "secret_kinds") and kinds == ["string"]:
            found = scalars.secret_kinds(columns[0])
            return Typed("list<string>", found) if name == "secret_kinds" else Typed("bool", F.size(found) > 0)
        near = difflib.get_close_matches(name, FUNCTIONS, 1)
        raise ExpressionError(f"no {name}({', '.join(kinds)})" + (f"; did you mean {near[0]!r}?" if near and near[0] != name else ""))


FUNCTIONS = ("size", "has", "int", "double", "string", "bool", "timestamp", "duration", "type", "dyn", "levenshtein", "soundex", "ngrams", "ngram_similarity", "point_in_polygon", "image_similar_to", "has_secrets", "secret_kinds", "contains", "startsWith", "endsWith", "matches", *_MACROS, *_ACCESSORS)
_CONVERSIONS = ("int", "double", "string", "bool", "timestamp", "duration")


def _whole_divide(a: Column, b: Column) -> Column:
    safe = F.when(b != 0, b).otherwise(F.lit(1).cast("bigint"))
    return F.call_function("try_divide", (a - a % safe).cast("decimal(38,0)"), safe.cast("decimal(38,0)")).cast("bigint")


def _seconds(interval: Column) -> Column:
    return (F.date_part(F.lit("DAY"), interval) * 86400 + F.date_part(F.lit("HOUR"), interval) * 3600 + F.date_part(F.lit("MINUTE"), interval) * 60 + F.date_part(F.lit("SECOND"), interval))


def _convert(name: str, x: Typed) -> Typed:
    c = F.try_variant_get(x.column, "$", schema.SPARK_TYPES.get(name, "string").replace("timestamp_ntz", "timestamp")) if x.kind == "dyn" else x.column
    kind = name if x.kind == "dyn" else x.kind
    if name == "int" and kind in ("int", "double", "string", "timestamp"):
        if kind == "string":
            return Typed("int", F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint")))
        if kind == "timestamp":
            return Typed("int", F.unix_seconds(c.cast("timestamp")))
        return Typed("int", c.try_cast("bigint"))
    if name == "double" and kind in ("int", "double", "string"):
        return Typed("double", c.try_cast("double"), float(x.constant) if isinstance(x.constant, (int, float)) else None)
    if name == "string" and kind in ("int", "double", "string", "bool", "timestamp"):
        return Typed("string", F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")) if kind == "timestamp" else c.cast("string"))
    if name == "bool" and kind in ("bool", "string"):
        return Typed("bool", F.when(c.isin("true", "True", "TRUE", "t", "1"), True).when(c.isin("false", "False", "FALSE", "f", "0"), False) if kind == "string" else c)
    if name == "timestamp" and kind in ("string", "timestamp"):
        return Typed("timestamp", _instant(c) if kind == "string" else c)
    if name == "duration" and isinstance(x.constant, str):
        return Typed("duration", F.expr(f"make_dt_interval(0, 0, 0, {_duration_seconds(x.constant)}BD)"))
    raise ExpressionError(f"no {name}({x.kind})")


def _instant(text: Column) -> Column:
    """RFC 3339 text as its UTC wall time, whatever the session's zone."""
    parts = r"^(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d(?:\.\d{1,9})?)([Zz]|[+-]\d\d:\d\d)$"
    local = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(text, parts, 1), F.substring(F.regexp_extract(text, parts, 2), 1, 15))).cast("timestamp_ntz")
    zone = F.regexp_extract(text, parts, 3)
    minutes = F.when(F.lower(zone) == "z", 0).otherwise((F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1))
    return F.when(text.rlike(parts), local - F.make_dt_interval(mins=minutes))


def _duration_seconds(text: str) -> str:
    units = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d+)?(?:ms|us|ns|h|m|s))+)", text)
    if not m:
        raise ExpressionError(f"not a duration: {text!r}")
    total = sum(float(n) * units[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)", m[2]))
    return f"{-total if m[1] == '-' else total:.6f}"


def predicate(text: str, variables: dict[str, tuple[str, Column]]) -> Column:
    """The filter column; true keeps a row, NULL (an error) and false drop it."""
    found = Compiler(variables).compile(parse(text))
    if found.kind not in ("bool", "dyn"):
        raise ExpressionError(f"a filter is true or false, not {found.kind}")
    return found.column


def rank(text: str, variables: dict[str, tuple[str, Column]]) -> Column:
    """The rank column: a number, or a test as 1 or 0; an error ranks 0."""
    found = Compiler(variables).compile(parse(text))
    if found.kind not in ("int", "double", "bool"):
        raise ExpressionError(f"a rank is a number or a test, not {found.kind}")
    return F.coalesce(found.column.cast("double"), F.lit(0.0))


def validate(text: str, variables: dict[str, tuple[str, Column]]) -> dict:
    """Whether *text* compiles, the error if not, and what it names."""
    compiler = Compiler(variables)
    try:
        kind = compiler.compile(parse(text)).kind
        error = None
    except ExpressionError as e:
        kind, error = None, str(e)
    return {"ok": error is None, "type": kind, "error": error, "variables": sorted(compiler.used_variables), "functions": sorted(compiler.used_functions)}
