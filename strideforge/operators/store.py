"""Tables written once to the folder that driver and executors share, for what several jobs read."""

import tempfile
import uuid


def shared_dir(spark):
    """The folder of spark.checkpoint.dir; where it is unset, a new local one if the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    return found


def written(df, name):
    """df, written once and read back: its plan is not run again for each action, and a lost executor costs its tasks only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
