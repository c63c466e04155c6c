"""Session helpers: a tuned local session and reliable lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "sitelens", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    Only a session that runs in one process (tests, benchmarks) may go without;
    it gets a temporary folder. A session with executors elsewhere that
    names none is an error, as no folder of one machine would outlive them.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("name a shared folder in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="sitelens-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from its files.

    The files outlive any executor, so a lost executor costs a re-read and not
    the job; and the planner knows their size, so it does not take what has
    grown for a side to broadcast. What was shuffled on the way is removed as soon as the
    table is written, else it would stay until the driver collects its garbage. The tables of
    a session are removed when its driver ends, or by :func:`drop_cut`.
    """
    spark = df.sparkSession
    folder = cut_folder(spark)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    return out


#: Spark's setting that removes the shuffle files of a query at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop_cut(*frames: DataFrame) -> None:
    """Remove tables that :func:`cut` has returned; frames that read them are then void."""
    for df in frames:
        for at, (owner, folder) in enumerate(_TABLES):
            if owner is df.sparkSession and folder == df._cut_folder:
                _remove(owner, folder)
                del _TABLES[at]
                break


def _remove(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_folder(spark: SparkSession) -> str:
    """A new folder for a table below the shared checkpoint folder, removed with those of :func:`cut`."""
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    _TABLES.append((spark, folder))
    return folder


def drop_cuts(spark: SparkSession, keep: int = 0) -> None:
    """Remove the tables that :func:`cut` has written in this session, but for the first ``keep``; frames that read them are then void."""
    for at in range(len(_TABLES) - 1, -1, -1):
        owner, folder = _TABLES[at]
        if owner is spark and at >= keep:
            _remove(spark, folder)
            del _TABLES[at]


_TABLES: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop_all() -> None:
    for spark in {id(s): s for s, _ in _TABLES}.values():
        try:
            drop_cuts(spark)
        except Exception:  # the session has ended: the cluster clears its folder
            pass
