"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# The JVM never compiles methods beyond this size.  With the limit, Spark drops whole-stage code
# that would be interpreted (conversions of wide tables) for projections that are split up.
HUGE_METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"
HUGE_METHOD_LIMIT = "8000"


def build_session(app: str = "recordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Everything here is a default: a cluster's own configuration wins because
    ``getOrCreate`` keeps an existing session and ``conf`` is applied last.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        HUGE_METHOD_CONF: HUGE_METHOD_LIMIT,
        # Rounds of an iteration leave no files behind once nothing refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Settings the registered queries rely on, for a session that was built elsewhere."""
    spark.conf.set(HUGE_METHOD_CONF, HUGE_METHOD_LIMIT)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a single-machine session that has none set gets a temporary one; on a
    cluster a machine-local folder would be lost with its executor, so that is
    an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, so that later plans start from it.

    The rows are written to the shared folder, hence they survive the loss of
    any executor and iterative plans stay short.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)
