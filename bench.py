"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilframe.plans.catalog import QUERIES  # noqa: E402
from veilframe.session import build_session  # noqa: E402

HEADLINE = (
    "k_anonymity", "k_anonymity_order_customers", "l_diversity", "l_diversity_lineitem", "t_closeness", "t_closeness_lineitem",
    "reid_risk", "privacy_report", "profile_lineitem", "describe_lineitem", "value_counts_lineitem", "missing_by_column",
    "column_catalogue", "dedupe", "impute_median", "impute_mode", "clean", "fill_directional", "age_features", "minmax_lineitem",
    "standard", "label_encode", "onehot", "prepare_features", "pseudonymise_id", "pseudonymise_hash", "pseudonymise_table",
    "similarity", "matrix_fidelity", "synthesise", "histogram_events", "density_histogram", "box_stats_events", "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "veilframe-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["k_anonymity"](spark, sf_dir).collect()  # class loading and code generation
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with contextlib.redirect_stdout(sys.stderr):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
