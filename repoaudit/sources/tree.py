"""Repository trees as rows.

Spark's own file sources leave out names that start with '_' or '.', so ``__init__.py``
would be lost. Tasks therefore list directories and read files themselves, through the
local file system for plain paths and through ``pyarrow.fs`` for URIs.

Listing and reading are separate steps: filters on the path run between them, before any
content is read, and the files of one large repository spread over all tasks.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from repoaudit.functions import paths

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BATCH_BYTES = 32 << 20
_BATCH_ROWS = 4096


def _is_uri(root: str) -> bool:
    return "://" in root


def _shown(name: str) -> str:
    """A name as text; bytes that are not UTF-8 become escapes like ``\\xe9``."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _local(root: str, path: str) -> bytes:
    """Where a shown path really is."""
    place = os.fsencode(root)
    for part in path.split("/") if path else ():
        name = os.fsencode(part)
        if b"\\x" in name and not os.path.lexists(os.path.join(place, name)):
            name = re.sub(rb"\\x([89a-f][0-9a-f])", lambda m: bytes([int(m[1], 16)]), name)
        place = os.path.join(place, name)
    return place


def _entries(root: str, below: str) -> Iterator[tuple[str, bool]]:
    """Direct entries of a directory as (relative path, is directory), links unfollowed."""
    prefix = f"{below}/" if below else ""
    if _is_uri(root):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for info in files.get_file_info(fs.FileSelector(f"{base}/{below}".rstrip("/"))):
            yield prefix + info.base_name, info.type == fs.FileType.Directory
        return
    with os.scandir(_local(root, below)) as found:
        for entry in found:
            name = prefix + _shown(entry.name)
            if entry.is_dir(follow_symlinks=False):
                yield name, True
            elif entry.is_file():
                yield name, False


def _is_root(root: str) -> bool:
    if _is_uri(root):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        return files.get_file_info(base).type == fs.FileType.Directory
    return os.path.isdir(root)


def _read(root: str, path: str) -> bytes | None:
    try:
        if _is_uri(root):
            from pyarrow import fs

            files, base = fs.FileSystem.from_uri(root)
            with files.open_input_stream(f"{base}/{path}") as stream:
                return stream.read()
        with open(_local(root, path), "rb") as stream:
            return stream.read()
    except OSError:
        return None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _directory_walker(whole: bool):
    """Task code: expand directories by one level, or down to the leaves if ``whole``."""
    schema = pa.schema(
        [("repo", pa.string()), ("root", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_())]
    )

    def walk(batches):
        rows: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if not row["is_dir"]:
                    rows.append((row["repo"], row["root"], row["path"], False))
                    continue
                pending = [row["path"]]
                while pending:
                    try:
                        for path, is_dir in _entries(row["root"], pending.pop()):
                            if is_dir and whole:
                                pending.append(path)
                            else:
                                rows.append((row["repo"], row["root"], path, is_dir))
                            if len(rows) >= _BATCH_ROWS:
                                yield _batch(rows, schema)
                                rows = []
                    except OSError:
                        continue
        yield _batch(rows, schema)

    return walk


def _spread(paths_: DataFrame, tasks: int | None) -> DataFrame:
    """Paths spread over a fixed number of tasks.

    Paths are short but what hangs on them is not, so adaptive execution, which would merge
    small partitions, is kept from it by the explicit number.
    """
    spark = paths_.sparkSession
    if tasks is None:
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(shuffle, 4 * spark.sparkContext.defaultParallelism)
    return paths_.repartition(tasks, "root", "path")


def check_roots(roots: DataFrame) -> DataFrame:
    """Add ``found`` to a ``(repo, root)`` table: whether the root is a directory."""
    schema = pa.schema([("repo", pa.string()), ("root", pa.string()), ("found", pa.bool_())])

    def check(batches):
        for batch in batches:
            rows = [(r["repo"], r["root"], _is_root(r["root"])) for r in batch.to_pylist()]
            yield _batch(rows, schema)

    return roots.select("repo", "root").mapInArrow(check, "repo string, root string, found boolean")


def list_files(roots: DataFrame, spread_levels: int = 2, tasks: int | None = None) -> DataFrame:
    """All files below each root as ``(repo, root, path)``, links to directories unfollowed.

    The first ``spread_levels`` levels are expanded one at a time with a shuffle between
    them, so that several tasks walk the parts of a large repository.
    """
    schema = "repo string, root string, path string, is_dir boolean"
    found = check_roots(roots).where("found")
    level = found.select("repo", "root", F.lit("").alias("path"), F.lit(True).alias("is_dir"))
    for _ in range(spread_levels):
        level = level.mapInArrow(_directory_walker(whole=False), schema)
        level = _spread(level, tasks)
    files = level.mapInArrow(_directory_walker(whole=True), schema)
    return files.select("repo", "root", "path")


def wanted(listing: DataFrame) -> DataFrame:
    """Keep the files some check looks at: scanned code, Python files and manifests."""
    path = F.col("path")
    return listing.where(
        paths.is_scanned_code(path) | paths.is_python(path) | paths.is_manifest(path)
    )


def read_contents(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Read listed files; unreadable ones are left out. Result ``(repo, path, content)``.

    Each of the ``tasks`` reads its files one after the other in batches of some 32 MB, so
    memory stays bounded whatever their number.
    """
    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def read(batches):
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                content = _read(row["root"], row["path"])
                if content is None:
                    continue
                rows.append((row["repo"], row["path"], content))
                size += len(content)
                if size >= _BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        yield _batch(rows, schema)

    return _spread(listing, tasks).mapInArrow(
        read, "repo string, path string, content binary"
    )


def read_trees(roots: DataFrame, tasks: int | None = None) -> DataFrame:
    """The ``source_files`` table of a ``(repo, root)`` table.

    Content stays binary: a ``setup.py`` is decoded in one way as code and in another as
    a manifest, so each check decodes for itself.
    """
    return read_contents(wanted(list_files(roots, tasks=tasks)), tasks)


def roots_table(spark: SparkSession, roots: dict[str, str] | list[str]) -> DataFrame:
    """A ``(repo, root)`` table of paths; a list uses the path itself as the key."""
    pairs = roots.items() if isinstance(roots, dict) else [(r, r) for r in roots]
    return spark.createDataFrame([(k, v) for k, v in pairs], "repo string, root string")

