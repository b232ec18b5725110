"""Tables written between jobs, in the folder that the cluster shares.

``kept`` cuts lineage with a Parquet table, so that a lost executor costs a re-read and not a recomputation.
The folder is ``spark.checkpoint.dir`` of the session.  Only with a local master may that be unset (tests,
notebooks): a local folder is made then.

Tables stay until their caller is done with them.  Those written inside ``with scope():`` are deleted at its
end; those of a named scope stay until ``release(name)``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[str] = []
_WRITTEN: dict[str, list[tuple[SparkSession, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a path that Spark understands."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[key]


def new_path(spark: SparkSession, name: str, owner: str | None = None) -> str:
    """A path in the shared folder, which belongs to the scope ``owner`` or else to the innermost open one."""
    path = f"{shared_dir(spark)}/symgraph/{name}-{uuid.uuid4().hex}"
    owner = owner or (_SCOPES[-1] if _SCOPES else None)
    if owner is not None:
        _WRITTEN.setdefault(owner, []).append((spark, path))
    return path


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as a table and read back, so that later jobs don't compute it again.

    With ``by`` its rows are dealt by these columns to as many files as shuffles have partitions: a small input is
    a few tasks', and so would be all that is read from its rows, however long they have become.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if by:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str | None = None) -> Iterator[None]:
    """Tables written inside belong to this scope; without a name they are deleted at its end."""
    own = name or uuid.uuid4().hex
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        if name is None:
            release(own)


def release(name: str) -> None:
    """Deletes the tables of a scope."""
    for spark, path in _WRITTEN.pop(name, []):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
