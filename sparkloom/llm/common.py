"""Helpers shared by the text operators: tables, shared storage, word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package.
SPACE = r"\x20\x09-\x0D"
#: Characters of SPACE, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows that Arrow hands to Python at once; documents may be long.
ARROW_ROWS = 500

_sent: list[object] = []
_made: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: send them this package, and bound the rows of an Arrow batch (a smaller setting stays)."""
    _send(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def _send(spark: SparkSession) -> None:
    context = spark.sparkContext
    if any(x is context for x in _sent):
        return
    _sent.append(context)
    top = Path(__file__).resolve().parent.parent
    where = Path(tempfile.mkdtemp(prefix="sparkloom-")) / f"{top.name}.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(where))  # the driver serves it to executors
    atexit.register(shutil.rmtree, where.parent, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; one is chosen only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that written() made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made[:] = [x for x in _made if x[1] != path]


def _remove_all() -> None:
    for spark, path in list(_made):
        try:
            removed(spark, path)
        except Exception:  # the session may be gone already
            return


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like wanted that do not clash with a column of df, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns, found by exact name even if another differs by case only."""
    return df.toDF(*[c if c in columns else f"__extra_{i}" for i, c in enumerate(df.columns)]).select(*columns)
