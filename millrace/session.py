"""Session settings and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on. Sizes (shuffle partitions, memory) are left to whoever starts the session.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
#: Keyed state of the streaming operators is kept outside the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = 8, name: str = "millrace", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = REQUIRED | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; Spark reads it, so the folder may be in any store that Spark knows."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Folders of applications in local mode that set none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all machines share; where that is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: for what is read more than once, or must outlive lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
