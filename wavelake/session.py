"""Session defaults and shared-storage locations.

Checkpoints and intermediate tables always go under the folder the cluster
names in ``spark.checkpoint.dir``.  Only a local-mode session (tests, the
bench) without that setting gets a private temporary folder.
"""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
import warnings
import zipfile

from pyspark.sql import SparkSession

# Defaults that matter at scale: AQE re-plans joins and coalesces small
# shuffle partitions at runtime, the skew-join rule splits hot partitions.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "wavelake",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with :data:`SCALE_DEFAULTS` applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SCALE_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cluster_conf(input_bytes: int, cores: int,
                 target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Sizing for a cluster run over ``input_bytes`` of input.

    Sorts and aggregations start with enough shuffle partitions that each
    holds about ``target_partition_bytes`` (a range partition cannot be split
    later), and AQE merges the small ones; scans split files at the same size.
    """
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
    }


def _is_local_file(spark: SparkSession, folder: str) -> bool:
    """True if ``folder`` resolves to the ``file`` scheme (a bare path stands
    for the default file system)."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).getScheme() == "file"


def _conf_checkpoint_root(spark: SparkSession) -> str | None:
    value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting it only when unset.

    A cluster must name a shared folder in ``spark.checkpoint.dir``; a
    local-mode session without one (tests) gets a private temporary folder.
    A ``file:`` folder may be a mount that all machines share or each
    machine's own disk, which cannot be told from here: on a cluster it is
    taken as the cluster names it, with a warning.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    root = _conf_checkpoint_root(spark)
    on_cluster = not sc.master.startswith("local")
    if root is not None and on_cluster and _is_local_file(spark, root):
        warnings.warn(f"spark.checkpoint.dir is {root!r}: it must be a folder that the driver and "
                      "all executors share", RuntimeWarning, stacklevel=2)
    if root is None:
        if on_cluster:
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder "
                "(HDFS, object store) for checkpoints and written tables")
        root = tempfile.mkdtemp(prefix="wavelake-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar(
    "wavelake_scratch_scopes", default=())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, next to the checkpoints."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")
    for scope in _SCOPES.get():
        scope.append(path)
    return path


@contextlib.contextmanager
def recorded_scratch():
    """The list of the intermediate tables made inside the block, for callers
    that delete them later."""
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(token)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the intermediate tables made inside when the block ends: for
    work whose results have been written or collected by then."""
    with recorded_scratch() as made:
        try:
            yield made
        finally:
            for path in made:
                drop_scratch(spark, path)


def scratch_root(spark: SparkSession) -> str:
    """Folder holding every intermediate table of this application."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables")


def drop_scratch(spark: SparkSession, path: str | None = None) -> bool:
    """Delete one intermediate table (or all of them) through the Hadoop
    file system of the path, so it works on HDFS and object stores alike.

    Results read lazily from these tables: drop them only after those
    results have been consumed."""
    target = path or scratch_root(spark)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(target)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(hpath, True))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries run inside are deleted when each of them
    ends, not when the driver happens to collect its garbage: for writes whose
    plan is not run again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wavelake`` importable in the Python workers of every executor
    (the ``--py-files`` route): the package is zipped once per application
    and handed to ``addPyFile``, which distributes it with the job.  Operators
    that run Python inside tasks call this before they plan."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="wavelake-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for name in filenames:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
