"""A local session with the settings that the plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    n = cpus or os.cpu_count() or 2
    base = {
        "spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("FOLIO_DRIVER_MEMORY", "8g"), "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{n}]").appName("folio").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
