"""Helpers shared by the text operators."""

from __future__ import annotations

import inspect
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the
    context. Only a local session without either gets a temporary folder; a cluster raises."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="text-ops-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, the rows survive a
    lost executor, and Spark knows the size when it plans joins. Folders are grouped under the
    application id, so they can be removed when the application has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``settle`` has returned, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "settled_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def others(df: DataFrame, results: list[str]) -> list[Column]:
    """The columns of ``df`` that no result column replaces; names may hold dots."""
    taken = {r.lower() for r in results}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


#: Parameters of operators that name a column of their first table.
_COLUMNS = ("doc_id", "text", "lang", "url", "ids")


def shielded(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator work on columns named by position, so that no name in the input, repeated
    ones included, meets one of its own. Afterwards the input's names come back, but for those that
    a result has taken."""
    signature = inspect.signature(op)

    @wraps(op)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        lower = [n.lower() for n in names]
        bound = signature.bind(docs.toDF(*[f"in{i}" for i in range(len(names))]), *args, **kwargs)
        bound.apply_defaults()
        for c in _COLUMNS:
            if c in bound.arguments:
                bound.arguments[c] = f"in{lower.index(bound.arguments[c].lower())}"
        out = op(*bound.args, **bound.kwargs)
        own = {f"in{i}": n for i, n in enumerate(names)}
        results = [c for c in out.columns if c not in own]
        taken = {r.lower() for r in results}
        return out.select(*[F.col(c).alias(own[c]) for c in out.columns
                            if c in own and own[c].lower() not in taken], *results)

    return run
