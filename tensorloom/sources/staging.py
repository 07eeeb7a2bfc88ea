"""Frames cut off from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint: iterations read it instead of making all earlier rounds again, and a lost executor costs one round.

    The folder is spark.checkpoint.dir; where that is unset, one of this machine's,
    but only if all of Spark runs in this one JVM.
    """
    sc = frame.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="tensorloom-checkpoints-")
            atexit.register(shutil.rmtree, root, True)
        sc.setCheckpointDir(root)
    return frame.checkpoint()
