"""File-system metadata calls through Hadoop, so any configured file system works."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_PATTERN_CHARACTERS = r"[\\*?\[\]{}]"

# How a data set with an inner order is laid out: one named file per piece, or a folder per piece.
LAYOUTS = ("files", "folders")

# Hidden files that hold no rows: marks of finished writes, checksums.
_BOOKKEEPING = re.compile(r"_SUCCESS|_temporary|_started.*|_committed.*|_metadata|_common_metadata|\..*\.crc")


def hadoop_path(spark: SparkSession, path: str):
    """Return ``(file system, path)`` handles for ``path``."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def private_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session like ``spark`` with ``settings`` of its own; tables made in either can be joined."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    for key, value in settings.items():
        session.conf.set(key, value)
    return session


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def delete_tree(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    fs, p = hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


def comparable_uri(path: str) -> str:
    """One spelling for ``file:/x`` and ``file:///x``."""
    return "file:///" + path[len("file:") :].lstrip("/") if path.startswith("file:/") else path


def spark_uri(file: Column) -> Column:
    """A file's name as a scan gives it, spelt as by :func:`file_uri`."""
    return F.regexp_replace(file, "^file:/+", "file:///")


def _literal(path: str) -> str:
    return re.sub(_PATTERN_CHARACTERS, r"\\\g<0>", path)


def _refuse_hidden(spark: SparkSession, path: str, found: list[str]) -> None:
    """Raise where Spark's readers would leave out a file of ``path`` for its name."""
    fs, p = hadoop_path(spark, path)
    if fs.getFileStatus(p).isFile():
        names = [p.getName()]
    else:
        folders = {path.rstrip("/"), *(f.rpartition("/")[0] for f in found)}
        to_path = spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for f in folders for s in fs.globStatus(to_path(f"{_literal(f)}/{{_,.}}*")) or []]
    hidden = [n for n in names if n[0] in "_." and "=" not in n and not _BOOKKEEPING.fullmatch(n)]
    if hidden:
        raise ValueError(f"Spark reads no file with such a name, rename it: {', '.join(sorted(hidden))} in {path}")


def list_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Data files behind ``paths``, in list order; a directory gives its files and those of its folders, by name.

    A path may be a pattern, unless a file has just that name. One listed twice counts once; one that
    is absent raises before anything is read, and so does one that Spark hides for its name (``_x``, ``.x``),
    unless it only marks a finished write. The result can be given to a reader: characters it takes
    for a pattern are escaped.
    """
    jvm = spark._jvm
    ordered: dict[str, None] = {}
    reader = spark.read.option("recursiveFileLookup", True)
    for path in dict.fromkeys(paths):
        named = exists(spark, path)
        uris = sorted(reader.text(_literal(path) if named else path).inputFiles())
        found = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString() for uri in uris]
        if named:
            _refuse_hidden(spark, path, found)
        for file in found:
            ordered.setdefault(_literal(file))
    return list(ordered)


def plain_path(path: str) -> str:
    """A path from :func:`list_inputs` without escapes."""
    return re.sub(r"\\(?=" + _PATTERN_CHARACTERS + ")", "", path)


def file_uri(spark: SparkSession, path: str) -> str:
    """A path from :func:`list_inputs` as ``input_file_name()`` spells it."""
    return comparable_uri(spark._jvm.org.apache.hadoop.fs.Path(plain_path(path)).toUri().toString())


def _scratch_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.gettempdir()
    return os.path.join(base, "rowsheaf", spark.sparkContext.applicationId)


# The folder that the scratch tables of the step in hand go into.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def scratch_scope(spark: SparkSession, label: str) -> Iterator[str]:
    """Put the scratch tables made inside into a folder of their own, for :func:`release` to drop together."""
    inner = os.path.join(_SCOPE.get(), f"{label}-{uuid.uuid4().hex}")
    token = _SCOPE.set(inner)
    try:
        yield os.path.join(_scratch_root(spark), inner)
    finally:
        _SCOPE.reset(token)


def release(spark: SparkSession, *folders: str) -> None:
    """Drop folders of scratch tables that nothing reads any more, and let Spark drop the shuffles behind them.

    Spark drops a shuffle's files once nothing on the driver refers to it and the driver has collected its garbage, which
    on a driver with memory to spare may be long after.
    """
    for folder in folders:
        delete_tree(spark, folder)
    gc.collect()
    spark._jvm.System.gc()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for this application under the cluster's shared checkpoint folder.

    The place comes from ``spark.checkpoint.dir``. Only a local session without that setting
    falls back to a temporary folder; on a cluster this would not be shared, so it raises.
    """
    return os.path.join(_scratch_root(spark), _SCOPE.get(), f"{label}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Drop all scratch tables of this application; results not yet written depend on them."""
    delete_tree(spark, _scratch_root(spark))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: lineage is cut, a lost executor costs nothing."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a whole number per row, called ``name``: its file's place among the files of ``df``, then its place there.

    For a table that is read from Parquet, the numbers are the same whenever and however it is read. Any other table
    is written first. The list of files, a row each, is broadcast; the rows aren't shuffled.
    """
    spark = df.sparkSession
    try:
        source = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias(name))
    except AnalysisException:
        return with_row_ids(materialise(df, "numbered"), name)
    files = sorted(comparable_uri(f) for f in df.inputFiles())
    numbers = spark.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "_uri string, _base long")
    found = source.join(F.broadcast(numbers), spark_uri(F.col("_path")) == F.col("_uri"), "left")
    number = F.coalesce(F.col("_base"), F.raise_error(F.lit("a file isn't in the table's list")).cast("long")) + F.col(name)
    return found.withColumn(name, number).drop("_path", "_uri", "_base")


def move_files(spark: SparkSession, staged: str, out: str, name_of: Callable[[str], str]) -> None:
    """Move the one file of each ``key=value`` folder of ``staged`` to ``out/name_of(value)``; metadata only.

    ``staged`` is dropped, and a success mark set last.
    """
    fs, root = hadoop_path(spark, staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(out)
    for folder in fs.listStatus(root):
        value = folder.getPath().getName().partition("=")[2]
        if not value:
            continue
        files = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
        if len(files) != 1:
            raise RuntimeError(f"{len(files)} files for {value}")
        if not fs.rename(files[0], path(target, name_of(value))):
            raise RuntimeError(f"could not name {name_of(value)}")
    fs.delete(root, True)
    fs.create(path(target, "_SUCCESS"), True).close()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def size_setting(spark: SparkSession, key: str) -> int:
    """A session setting such as ``128MB`` in bytes."""
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
