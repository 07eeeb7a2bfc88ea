"""Times the headline queries; prints one JSON line.

Nothing that a query derives from the tables is kept for the next one. The
flagship is also timed with 16 times and 12 modes, in a process of its own, as
extents are fixed at import.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tensorloom.queries import queries  # noqa: E402
from tensorloom.sources.derived import release  # noqa: E402

HEADLINE = (
    "a4_twopoint", "a4_twopoint_joins", "a5_twopoint_profile", "a7_twopoint_matrix", "a9_isoscalar_matrix", "a10_twopoint_momenta", "a12_operator_elementals",
    "a21_high_mode_both", "a22_diagram_triangle", "a22_diagram_box", "a25_effective_mass", "a26_ensemble_covariance", "a27_overlap", "n1_laplacian", "n5_elementals", "n9_distance_elemental",
    "s6_four_points", "n8_words_v2v", "l13_nucleon",
)


WIDE = {"TENSORLOOM_LT": "16", "TENSORLOOM_NE": "12"}


def measured(names: tuple[str, ...]) -> dict[str, float]:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for warm in (small, small) if os.path.isdir(small) else ():  # the JVM and the Python workers warm up, as for the baseline's figures
        every["a4_twopoint"](spark, warm).write.format("noop").mode("overwrite").save()
        release()
    took = {}
    for name in names:
        release()
        began = time.perf_counter()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    return took


def main() -> None:
    if "--wide" in sys.argv:
        print(json.dumps({f"{k}_16x12": v for k, v in measured(("a4_twopoint",)).items()}))
        return
    took = measured(HEADLINE)
    wide = subprocess.run([sys.executable, os.path.abspath(__file__), "--wide"], env=os.environ | WIDE, capture_output=True, text=True, timeout=600, check=False)
    if wide.returncode == 0:
        took |= json.loads(wide.stdout.strip().splitlines()[-1])
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
