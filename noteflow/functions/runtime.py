"""Session-level helpers: tables, staging in the shared folder, partition spread and skew-proof lookups."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Below this many rows a key is never hot: one task handles them easily.
HOT_ROWS = 20_000
#: Bytes of a part from which an input is not spread any further.
LARGE_PART = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on local[*] a new one where the session names none (as in
    tests). On a cluster a machine's own folder would be lost with the machine, so there the setting is required."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="noteflow-"))
        path = sc._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors, keeps column
    pruning. The files go when the Python process ends, or with `drop_stage`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noteflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._noteflow_path = path
    _paths.append((spark, path))
    return out


_paths: list[tuple[SparkSession, str]] = []


def drop_stage(*dfs: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in dfs:
        _delete(df.sparkSession, df._noteflow_path)
        _paths[:] = [(s, p) for s, p in _paths if p != df._noteflow_path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _paths:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone
            return


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of a session, once: their Python need not have it installed. The archive
    goes through the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/noteflow/{root.name}-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _paths.append((spark, path.toString()))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition CPU-heavy input only where it comes in fewer parts than the cluster has cores to use. A plain scan
    tells its splits without being run. A plan with exchanges would have to be run to tell, so its estimated size
    decides: large inputs come in enough parts and are not shuffled again."""
    want = 2 * parallelism(df.sparkSession)
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        enough = int(str(plan.optimizedPlan().stats().sizeInBytes())) > want * LARGE_PART
    else:
        enough = df.rdd.getNumPartitions() >= want
    return df if enough else df.repartition(want, *keys)


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Keys with more rows than max(HOT_ROWS, N / HOT_SHARE), with the number of salts that split them under that:
    fewer than HOT_SHARE rows by construction, so the result may be broadcast. N is counted unless given. Null keys
    never are hot (no join matches them)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows if rows is not None else df.count()
    most = max(HOT_ROWS, total // HOT_SHARE)
    return counts.where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / F.lit(most)).cast("int").alias("__salts"))


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """`big` joined with `small`, which has each key once; rows of hot keys are spread over salts and only the few
    hot rows of `small` are repeated. `big` is scanned once more for the key counts (combined map-side), so it
    should be a scan or a staged table; then a row's salt is the same again when its task is repeated. how: inner, left,
    left_semi or left_anti."""
    hot = hot_keys(big, keys, rows)
    salt = F.when(F.col("__salts").isNotNull(), F.floor(F.rand(7) * F.col("__salts")).cast("int")).otherwise(F.lit(0))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__salts")
    right = small.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    ).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
