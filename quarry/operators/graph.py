"""Queries over code-graph edges: definitions, references, calls and imports.

defs(path, language, kind, symbol, owner, exported), refs(symbol, path, language),
calls(caller, callee), imports(path, language, module), sites(symbol, path,
language, line, kind), boundary(kind, symbol, type, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.plans.cel import re2
from quarry.runtime import forget, join_each, stored
from quarry.sources import symbols

# Languages whose references are known; others never count as dead or untested.
REFERENCED = "go rust typescript javascript ruby swift kotlin c cpp python java csharp php perl r matlab scala".split()


def build(files: DataFrame) -> dict[str, DataFrame]:
    """The graph tables of source *files* (path, language, body and flags), from one stored pass over their texts.

    tests and generated hold the paths of such files; spans the functions with
    lines and complexity.
    """
    found = stored(symbols.symbols(files), "symbols")
    each = lambda column, *names: found.select("path", "language", F.explode(column).alias("x")).select("path", "language", *(f"x.{n}" for n in names))
    sites = each("uses", "symbol", "line", "kind")
    return {
        "files": found.select("path", "language", "is_test_file", "is_generated_code"),
        "defs": each("defs", "kind", "symbol", "owner", "exported"),
        "refs": sites.select("symbol", "path", "language").distinct(),
        "sites": sites,
        "imports": found.select("path", "language", F.explode("imports").alias("module")),
        "calls": each("calls", "caller", "callee").select("caller", "callee", "path"),
        "spans": each("spans", "function", "start_line", "end_line", "complexity"),
        "boundary": each("boundary", "kind", "symbol", "type"),
        "tests": found.where("is_test_file").select("path"),
        "generated": found.where("is_generated_code").select("path"),
    }


def imported_by(imports: DataFrame, module: str, mode: str = "exact") -> DataFrame:
    """Files that import *module*: exact, by prefix or by regular expression; each once."""
    m = F.col("module")
    test = {"exact": m == module, "prefix": m.startswith(module)}.get(mode)
    if test is None:
        test = F.rlike(m, F.lit(re2(module)))
    return imports.where(test).select("path", "language").distinct()


def find_definition(defs: DataFrame, symbol: str, kind: str | None = None) -> DataFrame:
    found = defs.where(F.col("symbol") == symbol)
    return (found.where(F.col("kind") == kind) if kind else found).select("kind", "path", "owner").distinct()


def who_calls(calls: DataFrame, symbol: str) -> DataFrame:
    return calls.where(F.col("callee") == symbol).select("caller").distinct()


def calls_of(calls: DataFrame, symbol: str) -> DataFrame:
    return calls.where(F.col("caller") == symbol).select("callee").distinct()


def owners_of(defs: DataFrame, symbol: str) -> DataFrame:
    """What owns the definitions of *symbol*."""
    return defs.where((F.col("symbol") == symbol) & (F.col("owner") != "")).select("owner").distinct()


def references(graph: dict[str, DataFrame], symbol: str, kind: str | None = None) -> DataFrame:
    """(path, line, kind, language) of every use of *symbol*: call, type or value; each line and kind once."""
    found = graph["sites"].where(F.col("symbol") == symbol)
    return (found.where(F.col("kind") == kind) if kind else found).select("path", "line", "kind", "language").distinct().orderBy("path", "line", "kind")


def trace(calls: DataFrame, symbol: str, depth: int = 0) -> DataFrame:
    """(relation, symbol, depth): who calls *symbol*, what it calls, and all that depend on it up to *depth* steps (< 1: any)."""
    one = lambda df, relation, name: df.select(F.lit(relation).alias("relation"), F.col(name).alias("symbol"), F.lit(1).alias("depth"))
    out = one(who_calls(calls, symbol), "caller", "caller").unionByName(one(calls_of(calls, symbol), "callee", "callee"))
    return out.unionByName(impact(calls, symbol, depth).select(F.lit("dependent").alias("relation"), "symbol", "depth"))


def import_hubs(imports: DataFrame, top: int = 20) -> DataFrame:
    """(module, importers): the modules that most files import."""
    return imports.groupBy("module").agg(F.count_distinct("path").alias("importers")).orderBy(F.col("importers").desc(), "module").limit(top)


def fan_out(imports: DataFrame, top: int = 20) -> DataFrame:
    """(path, modules): the files that import most."""
    return imports.groupBy("path").agg(F.count_distinct("module").alias("modules")).orderBy(F.col("modules").desc(), "path").limit(top)


def duplicate_definitions(defs: DataFrame, top: int = 20) -> DataFrame:
    """(symbol, files): symbols defined in more than one file."""
    found = defs.groupBy("symbol").agg(F.count_distinct("path").alias("files")).where("files > 1")
    return found.orderBy(F.col("files").desc(), "symbol").limit(top)


def overview(graph: dict[str, DataFrame]) -> DataFrame:
    """(measure, value): totals of the tables and files by language."""
    total = lambda name, df: df.agg(F.lit(name).alias("measure"), F.count("*").alias("value"))
    out = total("definitions", graph["defs"]).unionByName(total("references", graph["refs"])).unionByName(total("calls", graph["calls"])).unionByName(total("imports", graph["imports"]))
    by = graph["defs"].groupBy(F.concat(F.lit("language:"), "language").alias("measure")).agg(F.count_distinct("path").alias("value"))
    return out.unionByName(by)


def impact(calls: DataFrame, symbol: str, depth: int = 0) -> DataFrame:
    """(symbol, depth): all that call *symbol*, directly or not, with the fewest steps; *depth* < 1 means no limit.

    Breadth first: each round joins the last round's finds to the edges and drops
    what is known; rounds are stored.
    """
    edges = calls.select(F.col("caller").alias("to"), F.col("callee").alias("from")).distinct()
    spark = calls.sparkSession
    known = stored(spark.createDataFrame([(symbol, 0)], "symbol string, depth int"), "impact")
    front, level = known, 0
    while depth < 1 or level < depth:
        level += 1
        step = edges.join(front, edges["from"] == front["symbol"]).select(F.col("to").alias("symbol")).distinct()
        front = stored(step.join(known, "symbol", "left_anti").withColumn("depth", F.lit(level)), "impact")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known.where(F.col("depth") > 0)


def call_path(calls: DataFrame, start: str, end: str) -> DataFrame:
    """(path): the shortest chain of calls from *start* to *end*, of equals the first in order; no row without one.

    Each round keeps one least path for every symbol it reaches first, so there
    are as many rounds as the chain has steps, however long it is.
    """
    edges = stored(calls.select("caller", "callee").distinct(), "edges")
    spark = calls.sparkSession
    front = stored(spark.createDataFrame([(start, [start])], "symbol string, path array<string>"), "path")
    known = front.select("symbol")
    while not front.isEmpty():
        hit = front.where(F.col("symbol") == end)
        if start == end or not hit.isEmpty():
            return hit.select(F.array_join("path", " > ").alias("path"))
        step = edges.join(front, edges["caller"] == front["symbol"]).select(F.col("callee").alias("symbol"), F.concat("path", F.array("callee")).alias("path"))
        front = stored(step.join(known, "symbol", "left_anti").groupBy("symbol").agg(F.min("path").alias("path")), "path")
        known = known.unionByName(front.select("symbol"))
    return front.select(F.array_join("path", " > ").alias("path"))


def is_dispatched(kind: Column, symbol: Column, path: Column, language: Column) -> Column:
    """Entry points that a runtime or framework calls: Go's main, init and test entries, and command types by their names."""
    go = (language == "go") & (kind == "function")
    test = path.endswith("_test.go") & symbol.rlike("^(?:Test|Benchmark|Fuzz|Example)(?![a-z])")
    return (go & (symbol.isin("main", "init") | test)) | (~kind.isin("function", "method") & symbol.endswith("Cmd"))


def dead_code(defs: DataFrame, refs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(path, symbol, kind, language, owner, exported): definitions in *languages* (those of REFERENCED) that nothing refers to, without dispatched entry points."""
    known = REFERENCED if languages is None else languages
    own = defs.where(F.col("language").isin(known) & ~is_dispatched(F.col("kind"), F.col("symbol"), F.col("path"), F.col("language")))
    found = own.join(refs.select("symbol").distinct(), "symbol", "left_anti")
    return found.select("path", "symbol", "kind", "language", "owner", "exported").distinct().orderBy("path", "symbol", "kind")


def test_gaps(defs: DataFrame, refs: DataFrame, is_test: Column, boundary: DataFrame | None = None, languages: list[str] | None = None) -> DataFrame:
    """Per file, how many of its functions no test file refers to: path, total, untested, untested_functions; wholly untested first.

    *is_test* is a column over a path.  Functions that *boundary* shows as passed
    on as values or declared by an interface are reached under other names: they
    count neither way.
    """
    known = REFERENCED if languages is None else languages
    tested = refs.where(is_test).select("symbol").distinct().withColumn("t", F.lit(1))
    own = defs.where(~is_test & (F.col("kind") == "function") & F.col("language").isin(known))
    if boundary is not None:
        own = own.join(boundary.where(F.col("kind").isin("value", "interface")).select("symbol").distinct(), "symbol", "left_anti")
    met = own.join(tested, "symbol", "left")
    gap = F.when(F.col("t").isNull(), F.col("symbol"))
    out = met.groupBy("path").agg(F.count("*").alias("total"), F.count(gap).alias("untested"), F.array_sort(F.collect_list(gap)).alias("untested_functions")).where("untested > 0")
    return out.orderBy((F.col("untested") == F.col("total")).desc(), F.col("untested").desc(), "path")


def package_of(path: Column) -> Column:
    """The folder of a file."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def unused_exports(defs: DataFrame, refs: DataFrame, boundary: DataFrame | None = None, languages: tuple[str, ...] = ("go", "python")) -> DataFrame:
    """(symbol, kind, path, package): exported definitions that are used, but only in their own package.

    A symbol of several packages is left out, as are dispatched entry points,
    methods that an interface declares, and types in the signature of a function
    that is passed on as a value.  The files of an external test package are a
    package of their own.
    """
    own = defs.where(F.col("exported") & F.col("language").isin(*languages))
    used = refs.where(F.col("language").isin(*languages))
    package = package_of(F.col("path"))
    if boundary is not None:
        outside = boundary.where("kind = 'external_test'").select("path").distinct().withColumn("outside", F.lit(":test"))
        place = lambda df: df.join(outside, "path", "left").withColumn("package", F.concat(package, F.coalesce("outside", F.lit("")))).drop("outside")
    else:
        place = lambda df: df.withColumn("package", package)
    users = place(used).groupBy("symbol").agg(F.count_distinct("package").alias("users"), F.min("package").alias("user"))
    one = place(own).groupBy("symbol").agg(F.count_distinct("package").alias("homes"), F.min("package").alias("package"), F.min(F.struct("path", "kind", "language")).alias("d")).where("homes = 1")
    found = one.join(users, "symbol").where("users = 1 and user = package").select("symbol", "d.kind", "d.path", "d.language", "package")
    found = found.where(~is_dispatched(F.col("kind"), F.col("symbol"), F.col("path"), F.col("language"))).drop("language")
    if boundary is not None:
        handlers = boundary.where("kind = 'value'").select("symbol").distinct()
        pinned = boundary.where("kind = 'signature'").join(handlers, "symbol", "left_semi").select(F.col("type").alias("symbol"), F.lit("type").alias("kind"))
        declared = boundary.where("kind = 'interface'").select("symbol", F.lit("function").alias("kind"))
        found = found.join(pinned.unionByName(declared).distinct(), ["symbol", "kind"], "left_anti")
    return found.select("symbol", "kind", "path", "package").orderBy("package", "symbol", "kind")


def coupling(edges: DataFrame) -> DataFrame:
    """(node, ca, ce, instability) over edges (src, dst): distinct nodes in and out, ce / (ca + ce), 0 if isolated."""
    own = edges.where("src <> dst").distinct()
    sides = own.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(own.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(0).alias("o"), F.lit(0).alias("i"))
    out = sides.unionByName(alone).groupBy("node").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce"))
    return out.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0))


def _least_source(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each node of *edges* (src, dst), itself included.

    Each round takes the colours of all nodes before and then the colour of the
    colour, so a chain of n steps takes about log n rounds.  All joins shuffle:
    broadcasts would pass through the driver, again each round.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    colour = stored(nodes.withColumn("colour", F.col("node")), "colour")
    while True:
        pushed = edges.join(colour.hint("merge"), edges["src"] == colour["node"]).groupBy("dst").agg(F.min("colour").alias("c"))
        step = colour.join(pushed.hint("merge"), colour["node"] == pushed["dst"], "left").select("node", "colour", F.least("colour", "c").alias("near"))
        jump = colour.select(F.col("node").alias("near"), F.col("colour").alias("far"))
        new = stored(step.join(jump.hint("merge"), "near").select("node", F.least("near", "far").alias("colour"), (F.least("near", "far") < F.col("colour")).alias("moved")), "colour")
        forget(colour)
        colour = new
        if new.where("moved").isEmpty():
            return new.select("node", "colour")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component, size): strongly connected groups of more than one node; component is its least node.

    Nodes of a group agree on the least node that reaches them and on the least
    node that they reach.  Edges whose ends do not are dropped, until none is:
    then what is still connected is a group.
    """
    edges = stored(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    n = edges.count()
    while True:
        before = _least_source(edges)
        behind = _least_source(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        colour = stored(before.join(behind.select("node", F.col("colour").alias("behind")).hint("merge"), "node"), "colour")
        a, b = (colour.select(F.col("node").alias(x), F.col("colour").alias(f"c_{x}"), F.col("behind").alias(f"b_{x}")) for x in ("src", "dst"))
        edges = stored(edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("c_src = c_dst and b_src = b_dst").select("src", "dst"), "edges")
        left = edges.count()
        if left == n:
            sizes = colour.groupBy(F.col("colour").alias("component")).agg(F.count("*").alias("size"), F.count("*").alias("__n"))
            return join_each(colour.select("node", F.col("colour").alias("component")), sizes, "component").select("node", "component", "size")
        n = left


def groups(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph without directions."""
    return connected_components(edges, "src", "dst")
