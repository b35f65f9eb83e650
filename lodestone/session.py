"""Session settings and shared scratch tables.

Scratch tables cut long lineages. They are written below ``spark.checkpoint.dir``, which a
cluster shares between its executors; a folder of our own is used only where that setting is
missing (local tests).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def configured(builder):
    """The settings that the queries assume: UTC, adaptive plans, last value wins in maps."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that they can import it."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-code-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a new local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-", dir=_local_root())
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _local_root() -> str:
    import os

    root = "/tmp/checkpoints"
    os.makedirs(root, exist_ok=True)
    return root


def scratch(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table outlives lost executors, and later plans start from it. It is removed when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder; what is written there goes with the scratch tables."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_paths: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again."""
    for df in tables:
        _, path = _paths.pop(id(df), (None, None))
        for entry in [e for e in _written if e[1] == path]:
            _written.remove(entry)
            _remove(*entry)


def _remove(owner: SparkSession, path: str) -> None:
    try:
        p = owner.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


def drop_scratch(spark: SparkSession | None = None) -> None:
    """Remove the scratch tables written so far (of one session, or of all)."""
    rest = []
    for owner, path in _written:
        if spark is not None and owner is not spark:
            rest.append((owner, path))
            continue
        _remove(owner, path)
    _written[:] = rest
    left = {path for _, path in rest}
    for k in [k for k, (_, path) in _paths.items() if path not in left]:
        del _paths[k]


atexit.register(drop_scratch)
