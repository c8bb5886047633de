"""Session defaults and the two places where work is written down midway."""

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


SHUFFLE_BYTES = 256 * 2**20


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Partitions to start a shuffle of ``input_bytes`` with: small enough to sort in memory, two per core at least.

    Adaptive execution merges small ones afterwards but never splits large ones.
    """
    return max(2 * cores, -(-input_bytes // SHUFFLE_BYTES))


def build_session(
    app_name: str = "twinscript",
    master: str | None = None,
    input_bytes: int | None = None,
    cores: int = 1,
    **options: str,
) -> SparkSession:
    """A session with adaptive execution; ``options`` override single settings.

    ``input_bytes`` (what a job reads) and ``cores`` (of the cluster) size its shuffles.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if input_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions(input_bytes, cores))
        settings["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = "128m"
    settings.update(options)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders of stages that nobody has dropped yet with their owner, and what each stage's DataFrame was written to.
_open_stages: dict[str, str | None] = {}
_owner: list[str] = []
_stage_of: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    A local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; what is written there goes with ``drop_stages``."""
    path = f"{shared_folder(spark)}/twinscript/{label}-{uuid.uuid4().hex}"
    _open_stages[path] = _owner[-1] if _owner else None
    return path


def staged(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The written table cuts the lineage: a lost executor re-reads files, and two
    branches of a plan see the very same rows. It keeps real sizes for the
    optimizer, which an RDD checkpoint does not. It stays until ``drop_stage`` or
    ``drop_stages`` removes it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return stage_reader(df.sparkSession.read.schema(df.schema).parquet(path), path)


def stage_reader(df: DataFrame, path: str) -> DataFrame:
    """Note that ``df`` is what reads the stage at ``path``."""
    _stage_of[df] = path
    return df


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; with it the table of that folder, if the catalog has one."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    _open_stages.pop(path, None)
    if (table := _tables.pop(path, None)) is not None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


_tables: dict[str, str] = {}


def stage_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The catalog's table over a stage's files; the table goes when the stage is dropped."""
    _tables[path] = table
    return stage_reader(spark.table(table), path)


def drop_stage(*stages: DataFrame) -> None:
    """Remove what ``staged`` wrote for these. Nothing that still has to read them may be left."""
    for df in stages:
        path = _stage_of.pop(df, None)
        if path in _open_stages:
            _remove(df.sparkSession, path)


@contextmanager
def owned_stages(owner: str) -> Iterator[None]:
    """Stages written inside belong to ``owner``, who can drop them together."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def drop_stages(spark: SparkSession, *unread: DataFrame, owner: str | None = None) -> None:
    """Remove all stages (of ``owner``, if named) but those that the DataFrames ``unread`` still have to read.

    To be called when a result has been written: operators cannot know when their last reader is done.
    """
    mine = [path for path, of in _open_stages.items() if owner is None or of == owner]
    files = [f for df in unread for f in df.inputFiles()] if mine else []
    # Folder names are unique by themselves; the path before them may be written in other ways.
    for path in mine:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            _remove(spark, path)


def open_stages() -> list[str]:
    """Folders of the stages nobody has dropped yet."""
    return list(_open_stages)


MAX_SPREAD_SPLITS = 8


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of a few splits, fewer than there are cores, one split per core.

    A small file is one split and would keep one core busy. Any table of more than
    ``MAX_SPREAD_SPLITS`` splits passes through: shuffling it costs more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, MAX_SPREAD_SPLITS):
        return df
    return df.repartition(cores, *keys)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Literal rows as a local relation: its size is known to the optimizer and reading it starts no job."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.names]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.table(arrays, schema=arrow), schema)
