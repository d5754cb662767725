"""Session helpers: the shared folder and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, local mode) a
    fresh local folder is taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="barloom-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a plan reads one input more than once (block totals and block rows): the input is then
    computed once, the lineage is cut, and a lost executor costs a re-read and not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_staged(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with one row per key, staged first: its size is known when the join is planned.

    Where it is below the broadcast threshold of the session, ``df`` is not shuffled by the key at all (keys are few and may be hot);
    beyond the threshold it is a plain join.
    """
    return df.join(stage(few, "keyed"), list(keys), how)
