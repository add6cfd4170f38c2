"""Definitions, references and calls of source files: Python by its syntax tree, Go by its tokens, others by how they begin definitions.

What extract() finds for one file goes into nested columns, so graph tables are
plain explodes of one pass over the files.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import slices

#: What symbols() adds to (path, language).
SCHEMA = """
functions array<string>, type_names array<string>, imports array<string>,
defs array<struct<kind:string,symbol:string,owner:string,exported:boolean>>,
calls array<struct<caller:string,callee:string>>,
uses array<struct<symbol:string,line:int,kind:string>>,
spans array<struct<function:string,start_line:int,end_line:int,complexity:int>>,
boundary array<struct<kind:string,symbol:string,type:string>>
"""

#: How functions, types and imports begin in languages without a parser here.
DEFINES = {
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*use\s+([\w:]+)"),
    "javascript": (r"(?:^|\s)function\s*\*?\s+(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(", r"(?:^|\s)class\s+(\w+)", r"(?:from|require\()\s*['\"]([^'\"]+)"),
    "java": (r"^\s*(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$", r"\b(?:class|interface|enum|record)\s+(\w+)", r"^\s*import\s+(?:static\s+)?([\w.*]+)"),
    "ruby": (r"^\s*def\s+(?:self\.)?(\w+[?!]?)", r"^\s*(?:class|module)\s+(\w+)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)"),
    "c": (r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{]*\)\s*\{", r"\b(?:struct|enum|union)\s+(\w+)\s*\{", r"^\s*#include\s*[<\"]([^>\"]+)"),
    "shell": (r"^\s*(?:function\s+)?(\w+)\s*\(\)", r"(?!)", r"^\s*(?:source|\.)\s+(\S+)"),
    "php": (r"\bfunction\s+(\w+)", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)", r"^\s*use\s+([\w\\]+)"),
}
LIKE = {"typescript": "javascript", "cpp": "c", "csharp": "java", "kotlin": "java", "scala": "java", "swift": "rust", "zig": "rust"}

_PYTHON_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)


def _empty() -> dict:
    return {x.split()[0]: [] for x in re.split(r",\s*(?![^<]*>)", SCHEMA.strip())}


def _last(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def python_spans(tree: ast.AST) -> list[dict]:
    """Functions of Python source: branches and boolean operators, plus one."""
    out = []
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            n = 1 + sum(isinstance(x, _PYTHON_BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(f))
            out.append({"function": f.name, "start_line": f.lineno, "end_line": f.end_lineno, "complexity": n})
    return out


def python(text: str) -> dict:
    out, tree = _empty(), ast.parse(text)
    owner_of = {id(f): c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
    uses = set()

    def named(node: ast.AST | None, kind: str) -> None:
        for x in ast.walk(node) if node is not None else ():
            if isinstance(x, (ast.Name, ast.Attribute)) and _last(x):
                uses.add((_last(x), x.lineno, kind))

    for x in ast.walk(tree):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(x.name)
            out["defs"].append({"kind": "function", "symbol": x.name, "owner": owner_of.get(id(x), ""), "exported": not x.name.startswith("_")})
            out["calls"] += [{"caller": x.name, "callee": c} for c in dict.fromkeys(_last(y.func) for y in ast.walk(x) if isinstance(y, ast.Call)) if c]
            for d in x.decorator_list:
                named(d, "value")
            for a in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs, x.args.vararg, x.args.kwarg):
                named(a.annotation if a else None, "type")
            named(x.returns, "type")
        elif isinstance(x, ast.ClassDef):
            out["type_names"].append(x.name)
            out["defs"].append({"kind": "type", "symbol": x.name, "owner": "", "exported": not x.name.startswith("_")})
            for b in x.bases:
                named(b, "type")
        elif isinstance(x, ast.Import):
            out["imports"] += [a.name for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out["imports"].append(x.module or ".")
        elif isinstance(x, ast.AnnAssign):
            named(x.annotation, "type")
        elif isinstance(x, ast.Call):
            if _last(x.func):
                uses.add((_last(x.func), x.lineno, "call"))
            for a in (*x.args, *(k.value for k in x.keywords)):
                if _last(a):
                    uses.add((_last(a), a.lineno, "value"))
        elif isinstance(x, (ast.Name, ast.Attribute)) and isinstance(x.ctx, ast.Load):
            uses.add((_last(x), x.lineno, "value"))
    # a use that is more than a value counts as that only
    firm = {(s, n) for s, n, k in uses if k != "value"}
    out["uses"] = [{"symbol": s, "line": n, "kind": k} for s, n, k in sorted(uses) if k != "value" or (s, n) not in firm]
    out["spans"] = python_spans(tree)
    return out


_GO = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\d[\w.]*|&&|\|\||\.\.\.|\n|\S", re.S)
_GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
# Type names that the language itself declares.
_GO_TYPES = set("bool byte rune string error any comparable uintptr int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 complex64 complex128".split())


class _Go:
    """The tokens of a Go file: texts and lines, without comments; line ends stay."""

    def __init__(self, source: str):
        self.texts, self.lines, line = [], [], 1
        for m in _GO.finditer(source):
            t = m[0]
            if not t.startswith(("//", "/*")):
                self.texts.append(t)
                self.lines.append(line)
            elif "\n" in t:
                self.texts.append("\n")
                self.lines.append(line)
            line += t.count("\n")

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.texts) and (self.texts[i][0].isalpha() or self.texts[i][0] == "_") and self.texts[i] not in _GO_WORDS

    def at(self, i: int) -> str:
        return self.texts[i] if 0 <= i < len(self.texts) else ""

    def close(self, i: int) -> int:
        """Where the bracket at *i* ends."""
        depth = 0
        for j in range(i, len(self.texts)):
            depth += self.texts[j] in ("(", "[", "{")
            depth -= self.texts[j] in (")", "]", "}")
            if not depth:
                return j
        return len(self.texts) - 1

    def types(self, i: int, j: int) -> Iterator[tuple[str, int]]:
        """Type names among the tokens from *i* up to *j*: of pkg.T only T."""
        for k in range(i, j):
            if self.name(k) and self.at(k + 1) != "." and self.texts[k] not in _GO_TYPES:
                yield self.texts[k], self.lines[k]

    def fields(self, i: int, j: int, ends: tuple[str, ...]) -> Iterator[tuple[str, int]]:
        """Type names of the parameters or fields from *i* up to *j*, which *ends* part from each other."""
        pieces, start, k = [], i, i
        while k <= j:
            if k == j or self.texts[k] in ends:
                if k > start:
                    pieces.append((start, k))
                start = k + 1
            elif self.texts[k] in ("(", "[", "{"):
                k = self.close(k)
            k += 1
        begins_type = lambda k: self.name(k) or self.at(k) in ("*", "[", "(", "...", "map", "chan", "func", "struct", "interface", "<")
        two = [self.name(a) and b - a > 1 and begins_type(a + 1) for a, b in pieces]
        for (a, b), named in zip(pieces, two):
            if named or not any(two):
                yield from self.types(a + 1 if named else a, b)


def go(text: str) -> dict:
    out, g, n = _empty(), _Go(text), 0
    uses, boundary, i = [], [], 0
    n = len(g.texts)
    capital = lambda s: s[:1].isupper()

    def define(kind: str, symbol: str, owner: str = "") -> None:
        out["functions" if kind == "function" else "type_names"].append(symbol)
        out["defs"].append({"kind": kind, "symbol": symbol, "owner": owner, "exported": capital(symbol)})

    def spec(i: int) -> int:
        """One type declaration from its name on; the place after it."""
        define("type", g.texts[i])
        k = i + 1
        if g.at(k) == "[" and g.name(k + 1) and g.at(k + 2) != "]":
            k = g.close(k) + 1
        k += g.at(k) == "="
        begin = k
        while k < n and g.texts[k] not in ("\n", ";"):
            if g.texts[k] == "{":
                end = g.close(k)
                kind = g.at(k - 1)
                if kind == "interface":
                    line_start = True
                    for m in range(k + 1, end):
                        if g.texts[m] in ("\n", ";"):
                            line_start = True
                            continue
                        if line_start and g.name(m) and g.at(m + 1) == "(":
                            boundary.append(("interface", g.texts[m], ""))
                            uses.extend((s, x, "type") for s, x in g.fields(m + 2, g.close(m + 1), (",",)))
                        elif line_start and g.name(m):
                            uses.extend((s, x, "type") for s, x in g.types(m, m + 1))
                        line_start = False
                elif kind == "struct":
                    start = k + 1
                    for m in range(k + 1, end + 1):
                        if g.texts[m] in ("\n", ";") or m == end:
                            if m > start:
                                last = m - (g.at(m - 1)[:1] in ("`", '"'))
                                first = start
                                while g.name(first) and g.at(first + 1) == ",":
                                    first += 2
                                plain = last - first > 1 and g.name(first) and g.at(first + 1) != "."
                                uses.extend((s, x, "type") for s, x in g.types(first + 1 if plain else first, last))
                            start = m + 1
                k = end
            k += 1
        if g.at(begin) not in ("struct", "interface"):
            uses.extend((s, x, "type") for s, x in g.types(begin, k))
        return k

    def body(a: int, b: int, caller: str) -> int:
        """Calls, values and types used from *a* up to *b*; the number of branches."""
        branches, seen = 0, set()
        for k in range(a, b):
            t = g.texts[k]
            branches += t in ("if", "for", "case", "&&", "||")
            if not g.name(k):
                continue
            call = g.at(k + 1) == "(" and g.at(k - 1) != "func"
            if g.at(k + 1) == "[" and not call:
                end = g.close(k + 1)
                call = g.at(end + 1) == "(" and end > k + 2 and all(g.name(m) or g.at(m) in (",", ".", "*") for m in range(k + 2, end))
            if call:
                uses.append((t, g.lines[k], "call"))
                if caller and t not in seen:
                    seen.add(t)
                    out["calls"].append({"caller": caller, "callee": t})
                open_at = k + 1 if g.at(k + 1) == "(" else g.close(k + 1) + 1
                end, start, m = g.close(open_at), open_at + 1, open_at + 1
                while m <= end:
                    if m == end or g.texts[m] == ",":
                        own = [x for x in range(start, m) if g.texts[x] != "\n"]
                        if own and all(g.name(x) if j % 2 == 0 else g.texts[x] == "." for j, x in enumerate(own)) and len(own) % 2:
                            uses.append((g.texts[own[-1]], g.lines[own[-1]], "value"))
                            boundary.append(("value", g.texts[own[-1]], ""))
                        start = m + 1
                    elif g.texts[m] in ("(", "[", "{"):
                        m = g.close(m)
                    m += 1
            elif g.at(k + 1) == "{" and (g.at(k - 1) in ("&", "=", "(", ",", "]", "return", ":", "*", ".", "{") or g.at(k - 2) == ":") and capital(t) | (g.at(k - 1) in ("&", "]")):
                uses.extend((s, x, "type") for s, x in g.types(k, k + 1))
            elif g.at(k - 1) == "(" and g.at(k - 2) == "." and g.at(k + 1) in (")", "."):
                uses.extend((s, x, "type") for s, x in g.types(k, g.close(k - 1)))
            elif g.at(k - 1) == "var" or g.at(k - 1) == "const":
                m = k + 1
                while m < b and g.texts[m] not in ("=", "\n", ";"):
                    m += 1
                uses.extend((s, x, "type") for s, x in g.types(k + 1, m))
        return branches

    while i < n:
        t = g.texts[i]
        if t == "package" and g.name(i + 1):
            if g.texts[i + 1].endswith("_test"):
                boundary.append(("external_test", "", ""))
            i += 2
        elif t == "import":
            end = g.close(i + 1) if g.at(i + 1) == "(" else next((k for k in range(i, n) if g.texts[k] == "\n"), n)
            out["imports"] += [x[1:-1] for x in g.texts[i:end] if x[:1] in ('"', "`")]
            i = end + 1
        elif t == "func" and (g.name(i + 1) or g.at(i + 1) == "("):
            start, k, owner = i, i + 1, ""
            if g.at(k) == "(":
                end = g.close(k)
                names = [s for s, _ in g.fields(k + 1, end, (",",))]
                owner = names[0] if names else ""
                k = end + 1
            if not g.name(k):
                i = k + 1
                continue
            symbol = g.texts[k]
            define("function", symbol, owner)
            k += 1
            if g.at(k) == "[":
                k = g.close(k) + 1
            end = g.close(k)
            used = list(g.fields(k + 1, end, (",",)))
            k = end + 1
            begin = k
            while k < n and g.texts[k] not in ("\n", "{"):
                k = g.close(k) + 1 if g.texts[k] in ("(", "[") else k + 1
                if g.at(k) == "{" and g.at(k - 1) in ("interface", "struct"):
                    k = g.close(k) + 1
            used += g.fields(begin + 1, g.close(begin), (",",)) if g.at(begin) == "(" else g.types(begin, k)
            uses.extend((s, x, "type") for s, x in used)
            boundary.extend(("signature", symbol, s) for s, _ in used if capital(s))
            if g.at(k) == "{":
                end = g.close(k)
                branches = body(k + 1, end, symbol)
                out["spans"].append({"function": symbol, "start_line": g.lines[start], "end_line": g.lines[end], "complexity": 1 + branches})
                k = end
            i = k + 1
        elif t == "type":
            if g.at(i + 1) == "(":
                end, k, fresh = g.close(i + 1), i + 2, True
                while k < end:
                    if g.texts[k] in ("\n", ";"):
                        fresh, k = True, k + 1
                    elif fresh and g.name(k):
                        fresh, k = False, spec(k)
                    else:
                        k += 1
                i = end + 1
            else:
                i = spec(i + 1) if g.name(i + 1) else i + 1
        elif t in ("var", "const"):
            end = i + 1
            while end < n and g.texts[end] != "\n":
                end = g.close(end) + 1 if g.texts[end] in ("(", "{", "[") else end + 1
            body(i, end, "")
            if g.at(i + 1) == "(":
                begin = i + 2
                for k in range(i + 2, end):
                    if g.texts[k] == "\n":
                        stop = next((m for m in range(begin, k) if g.texts[m] == "="), k)
                        uses.extend((s, x, "type") for s, x in g.types(begin + 1, stop))
                        begin = k + 1
            i = end
        else:
            i += 1
    out["uses"] = [{"symbol": s, "line": x, "kind": k} for s, x, k in sorted(set(uses))]
    out["boundary"] = [{"kind": k, "symbol": s, "type": t} for k, s, t in sorted(set(boundary))]
    return out


_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|//[^\n]*|#(?![{\w])[^\n]*|/\*.*?\*/", re.S)
_CALL = re.compile(r"(\b[^\W\d]\w*)\s*\(")
_NO_CALL = set("if for while switch catch return function sizeof fn def match elif until unless foreach synchronized using lock when and or not in new typeof instanceof await".split())


def by_rules(text: str, language: str) -> dict:
    """By how definitions begin; a function ends where its braces do, or before the next one."""
    out = _empty()
    rules = DEFINES.get(LIKE.get(language, language))
    if rules is None:
        return out
    pick = lambda m: next(x for x in m.groups() if x)
    bare = _STRINGS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line_of = lambda at: text.count("\n", 0, at) + 1
    found = [(m.start(next(k for k, x in enumerate(m.groups(), 1) if x)), pick(m)) for m in re.finditer(rules[0], text, re.M)]
    out["functions"], out["type_names"], out["imports"] = [x for _, x in found], [pick(m) for m in re.finditer(rules[1], text, re.M)], [pick(m) for m in re.finditer(rules[2], text, re.M)]
    shown = lambda at: re.search(r"\b(?:pub|public|export|open)\b", text[text.rfind("\n", 0, at) + 1 : at]) is not None or language in ("ruby", "c", "cpp", "php", "shell")
    out["defs"] = [{"kind": "function", "symbol": x, "owner": "", "exported": shown(at)} for at, x in found]
    out["defs"] += [{"kind": "type", "symbol": pick(m), "owner": "", "exported": shown(m.end())} for m in re.finditer(rules[1], text, re.M)]
    defined = {at for at, _ in found}
    sites = [(m.start(1), m[1]) for m in _CALL.finditer(bare) if m[1] not in _NO_CALL and m.start(1) not in defined]
    for k, (at, name) in enumerate(found):
        stop = found[k + 1][0] if k + 1 < len(found) else len(text)
        brace = bare.find("{", at, stop)
        if brace >= 0:
            depth, end = 0, brace
            for m in re.compile(r"[{}]").finditer(bare, brace):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    end = m.start()
                    break
            stop = max(end, at)
        callees = dict.fromkeys(x for p, x in sites if at < p < stop)
        out["calls"] += [{"caller": name, "callee": x} for x in callees]
        branches = len(re.findall(r"\b(?:if|elif|for|while|case|catch|rescue|when|unless|until)\b|&&|\|\|", bare[at:stop]))
        out["spans"].append({"function": name, "start_line": line_of(at), "end_line": line_of(stop if stop < len(text) else len(text.rstrip())), "complexity": 1 + branches})
    uses = {(x, line_of(p), "call") for p, x in sites}
    uses |= {(m[1], line_of(m.start(1)), "type") for m in re.finditer(r"\b(?:new|extends|implements|struct|impl)\s+(\w+)", bare)}
    uses |= {(m[1], line_of(m.start(1)), "value") for m in re.finditer(r"\b(\w+)(?=\s*[.:]{1,2}\s*\w)", bare)}
    out["uses"] = [{"symbol": s, "line": n, "kind": k} for s, n, k in sorted(uses)]
    return out


def extract(text: str, language: str) -> dict:
    """The symbols of one file; nothing where the language is unknown or the text does not parse."""
    try:
        return python(text) if language == "python" else go(text) if language == "go" else by_rules(text, language)
    except (SyntaxError, ValueError, RecursionError, StopIteration):
        return _empty()


def _run(batches):
    for whole in batches:
        for start, end in slices(whole["body"]):
            pdf = whole.iloc[start:end]
            rows = [extract(b or "", x or "") for b, x in zip(pdf["body"], pdf["language"])]
            yield pd.concat([pdf.drop(columns=["body"]).reset_index(drop=True), pd.DataFrame(rows, columns=list(_empty()))], axis=1)


def symbols(files: DataFrame) -> DataFrame:
    """(path, language, is_test_file, is_generated_code and SCHEMA) of source *files* with path, language and body; one pass over their texts."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in files.columns else F.lit(False)
    rows = files.select("path", "language", flag("is_test_file").alias("is_test_file"), flag("is_generated_code").alias("is_generated_code"), "body")
    return rows.mapInPandas(_run, f"path string, language string, is_test_file boolean, is_generated_code boolean, {SCHEMA}")


def function_bodies(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, symbol, lines, start_line, body): the text of each function, for duplicate functions and function chunks."""
    at = found.select("path", F.explode("spans").alias("s"))
    lines = F.split("body", "\n")
    met = at.join(files.select("path", "body"), "path")
    n = F.col("s.end_line") - F.col("s.start_line") + 1
    return met.select("path", F.col("s.function").alias("symbol"), n.alias("lines"), F.col("s.start_line").alias("start_line"), F.array_join(F.slice(lines, F.col("s.start_line"), n), "\n").alias("body"))
