"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder that spark.checkpoint.dir names. Where that is unset, a session in one process gets a folder of its own (tests), and any other is refused."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-checkpoint-"))
    return df.checkpoint()
