"""Results that are computed once and used several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage in the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``. Where it is unset, one is made if all
    tasks run in this process (``local[n]``, as in tests); a cluster without it is an error, as
    a folder of one machine would lose rows there.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyforge-"))
    return df.checkpoint(eager=True)
