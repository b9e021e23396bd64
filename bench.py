"""Headline timings: prints one JSON line.

Raw extracts are derived from the tables and written once, untimed; each query then runs from
those files to a no-op sink (the whole result is computed, nothing is collected).
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import SparkSession

from siteshift.layouts import REQUIRED
from siteshift.operators import explain
from siteshift.plans import transform as t
from siteshift.plans import validate as v
from siteshift.session import shared_folder, tune
from siteshift.sources.normalize import normalize_extract
from workload.extracts import raw_extracts, with_faults


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = tune(
        SparkSession.builder.master(f"local[{cpus}]").appName("siteshift-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"

    def stored(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    raw = {name: stored(df.repartition(int(cpus)), f"raw_{name}") for name, df in raw_extracts(spark, sf_dir, every_line=False).items()}
    tables = {name: normalize_extract(df, name, required_only=True) for name, df in raw.items()}
    expected = {s: stored(t.transform_table(s, tables), f"expected_{s}") for s in ("MARC", "MBEW")}
    actual = {s: stored(with_faults(expected[s], s), f"actual_{s}") for s in ("MARC", "MBEW")}
    marc = stored(tables["MARC"].select(*REQUIRED["MARC"], "_row_id"), "marc")
    paired = lambda: explain.pair_with_source(expected["MARC"], marc)

    queries = {
        "transform_marc": lambda: t.transform_table("MARC", tables),
        "transform_mbew": lambda: t.transform_table("MBEW", tables),
        "validate_expected_actual": lambda: v.validate_expected_actual("MARC", expected["MARC"], actual["MARC"]),
        "validate_by_plant": lambda: v.validate_by_plant("MARC", expected["MARC"], actual["MARC"]),
        "preview_changes": lambda: explain.preview_changes(paired()),
        "preview_unmapped": lambda: explain.preview_unmapped(marc, paired(), tables["MARA"]),
    }
    seconds = {}
    for name, build in queries.items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
