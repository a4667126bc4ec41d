"""API check: calls of functions that a module does not offer."""

from __future__ import annotations

import ast
import gc
import sys
import warnings

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from repoaudit.functions import paths, text
from repoaudit.functions.similarity import equal_positions
from repoaudit.operators.joins import join_hot_keys
from repoaudit.rules import KNOWN_APIS, any_of, known_api_table
from repoaudit.session import freeze

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FINDING_ORDER = ["file", "line_number", "walk_ord"]

_IMPORT = pa.struct([("walk_ord", pa.int32()), ("alias", pa.string()), ("module", pa.string())])
_CALL = pa.struct(
    [
        ("walk_ord", pa.int32()),
        ("line_number", pa.int32()),
        ("alias", pa.string()),
        ("module", pa.string()),
        ("called_function", pa.string()),
    ]
)
_PARSED = pa.schema(
    [
        ("repo", pa.string()),
        ("file", pa.string()),
        ("parsed", pa.bool_()),
        ("imports", pa.list_(_IMPORT)),
        ("calls", pa.list_(_CALL)),
    ]
)
_PARSED_DDL = (
    "repo string, file string, parsed boolean, "
    "imports array<struct<walk_ord:int,alias:string,module:string>>, "
    "calls array<struct<walk_ord:int,line_number:int,alias:string,module:string,called_function:string>>"
)


def _dotted(node: ast.expr) -> list[str] | None:
    """Names of ``a.b`` or ``a.b.c``, outermost last; None for any other expression."""
    names: list[str] = []
    while isinstance(node, ast.Attribute) and len(names) < 2:
        names.append(node.attr)
        node = node.value
    if not names or not isinstance(node, ast.Name):
        return None
    return [node.id, *reversed(names)]


def _imports_and_calls(tree: ast.AST) -> tuple[list, list]:
    """Import and call nodes in breadth-first order, the order that decides on aliases.

    Most nodes of a tree have nothing below them, so those are not queued.
    """
    found: dict[type, list] = {ast.Import: [], ast.Call: []}
    level = [tree]
    while level:
        below: list[ast.AST] = []
        for node in level:
            if (kept := found.get(node.__class__)) is not None:
                kept.append(node)
            for field in node._fields:
                value = getattr(node, field, None)
                children = value if value.__class__ is list else (value,)
                below += [c for c in children if isinstance(c, ast.AST) and c._fields]
        level = below
    return found[ast.Import], found[ast.Call]


def _syntax(source: str, walk: bool) -> tuple[list, list] | None:
    """Imports of one file and its dotted calls on them as tuples; None if it does not parse.

    The last import of an alias in the order of the walk says which module a call means, also
    for calls above it.
    """
    try:
        tree = ast.parse(source)
        imports, calls = _imports_and_calls(tree) if walk else ([], [])
        imported = [
            (at, n.asname or n.name, n.name.partition(".")[0])
            for at, node in enumerate(imports)
            for n in node.names
        ]
        module_of = {alias: module for _, alias, module in imported}
        return (
            imported,
            [
                (at, node.lineno, names[0], module_of[names[0]], ".".join(names[1:]))
                for at, node in enumerate(calls)
                if (names := _dotted(node.func)) and names[0] in module_of
            ],
        )
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as an Arrow list of structs, built column by column."""
    offsets, flat = [0], []
    for row in rows:
        flat += row
        offsets.append(len(flat))
    columns = list(zip(*flat)) if flat else [()] * kind.num_fields
    structs = pa.StructArray.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, kind)], fields=list(kind)
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def _parse_batches(batches):
    # Syntax trees hold no reference cycles, and tracing them takes a third of the time.
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for batch in batches:
                pairs = zip(batch.column("content"), batch.column("walk"))
                found = [_syntax(source.as_py(), walk.as_py()) for source, walk in pairs]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("repo"),
                        batch.column("file"),
                        pa.array([f is not None for f in found], pa.bool_()),
                        _lists([f[0] if f else [] for f in found], _IMPORT),
                        _lists([f[1] if f else [] for f in found], _CALL),
                    ],
                    schema=_PARSED,
                )
    finally:
        gc.enable()


def _may_import(content: Column, modules) -> Column:
    """Whether a text can import one of the modules, or any module if none are given.

    Python folds some non-ASCII letters in names, so texts holding any always may.
    """
    some = F.contains(content, F.lit("import"))
    if modules is not None:
        some = some & any_of([F.contains(content, F.lit(m)) for m in modules])
    return some | (F.length(content) != F.octet_length(content))


def parse_python(files: DataFrame, modules=None) -> DataFrame:
    """Syntax facts of each Python file, one row per file, in one narrow Arrow stage.

    The code is parsed, never run. Calls leave the parser with the module of their alias, so
    neither a shuffle nor a copy of the file's imports is needed for it. All files are parsed,
    but with a list of ``modules`` only those that may import one of them are searched for
    imports and calls.
    """
    own = paths.of_kind(files, "setup", "python").where(paths.is_python(F.col("path")))
    own = text.code_text(own).where("content is not null")
    walk = _may_import(F.col("content"), modules)
    return own.select(
        "repo", F.col("path").alias("file"), "content", walk.alias("walk")
    ).mapInArrow(_parse_batches, _PARSED_DDL)


def py_imports(parsed: DataFrame) -> DataFrame:
    """Imports as rows: ``(repo, file, walk_ord, alias, module)``."""
    return parsed.select("repo", "file", F.explode("imports").alias("_import")).select(
        "repo", "file", "_import.walk_ord", "_import.alias", "_import.module"
    )


def py_calls(parsed: DataFrame) -> DataFrame:
    """Calls on imported modules: ``(repo, file, walk_ord, line_number, alias, module,
    called_function)``."""
    calls = parsed.where(F.size("calls") > 0).select("repo", "file", F.explode_outer("calls").alias("_call"))
    names = ("walk_ord", "line_number", "alias", "module", "called_function")
    return calls.select("repo", "file", *[f"_call.{n}" for n in names])


# A table of known names is broadcast up to this many rows, and a module's names are put
# into arrays of about this many.
BROADCAST_NAMES = 500_000
ARRAY_NAMES = 1000


def _suggestions(bad: DataFrame, known: DataFrame, known_rows: int) -> DataFrame:
    """Text for each distinct bad ``(module, called_function)``.

    The names of a module sit in arrays and the best one is a maximum over them, so no
    pairs of calls and names come into being. Ties go to the first name in the alphabet.
    """
    share = F.pmod(F.xxhash64("name"), F.lit(max(1, known_rows // ARRAY_NAMES)))
    names = known.groupBy("module", share.alias("share")).agg(
        F.collect_list("name").alias("names")
    )
    top = F.split_part(F.col("called_function"), F.lit("."), F.lit(1))
    scored = F.transform(
        "names", lambda n: F.struct((-equal_positions(top, n)).alias("rank"), n.alias("name"))
    )
    best = (
        bad.select("module", "called_function")
        .distinct()
        .join(_if_small(names, known_rows), "module")
        .groupBy("module", "called_function")
        .agg(F.min(F.array_min(scored)).alias("_best"))
    )
    called = F.concat(F.lit("'"), "module", F.lit("."), "called_function", F.lit("'"))
    return best.select(
        "module",
        "called_function",
        F.when(
            F.col("_best.rank") <= -2,
            F.concat(called, F.lit(" does not exist. Did you mean '"), "module", F.lit("."),
                     F.col("_best.name"), F.lit("'?")),
        )
        .otherwise(
            F.concat(called, F.lit(" does not exist in the '"), "module",
                     F.lit("' package. Verify the correct function name in the official documentation."))
        )
        .alias("suggestion"),
    )


def _if_small(known: DataFrame, known_rows: int) -> DataFrame:
    return F.broadcast(known) if known_rows <= BROADCAST_NAMES else known


def check_calls(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls whose first name after the module is not in the ``(module, name)`` table.

    The known names are counted first. Up to ``BROADCAST_NAMES`` of them are broadcast and
    the calls stay where they are; beyond that Spark joins by shuffle. The bad calls, a
    small rest, are frozen, so no file is parsed twice. Suggestions are made once per
    distinct call and go back to the rows through a join that copes with frequent ones.
    """
    known = known.select("module", "name").distinct()
    rows = known.count()
    modules = known.select("module").distinct()
    top = F.split_part(F.col("called_function"), F.lit("."), F.lit(1))
    bad = freeze(
        calls.join(_if_small(modules, rows), "module", "left_semi")
        .withColumn("name", top)
        .join(_if_small(known, rows), ["module", "name"], "left_anti")
        .drop("name")
    )
    suggested = _suggestions(bad, known, rows)
    judged = join_hot_keys(bad, suggested, ["module", "called_function"])
    return judged.select(
        "repo",
        "file",
        "line_number",
        "walk_ord",
        "module",
        "called_function",
        F.lit(False).alias("exists_in_api"),
        "suggestion",
    )


def check_api_calls(files: DataFrame, known_apis=None) -> DataFrame:
    """API findings of the ``source_files`` table."""
    known = known_api_table(files.sparkSession, known_apis)
    return check_calls(py_calls(parse_python(files, literal_modules(known_apis))), known)


def literal_modules(known_apis=None):
    """Module names where they are known before the run: not for a table, None then."""
    if isinstance(known_apis, DataFrame):
        return None
    return sorted(KNOWN_APIS if known_apis is None else known_apis)


def api_counts(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository: bad calls and parsed files."""
    scanned = parsed.groupBy("repo").agg(F.count_if("parsed").alias("total_files_scanned"))
    bad = findings.groupBy("repo").agg(F.count("*").alias("total_hallucinated_calls"))
    return scanned.join(bad, "repo", "left").select(
        "repo",
        F.coalesce("total_hallucinated_calls", F.lit(0)).alias("total_hallucinated_calls"),
        "total_files_scanned",
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("repo", *FINDING_ORDER)
