"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Panel builds (raw tables to indexed bars) are timed as entries of their own; the queries
after them read the staged bars, as they would on a cluster.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pairtide.config import PairSpec, RoleSpec  # noqa: E402
from pairtide.operators import metrics, roles, timeline, windows  # noqa: E402
from pairtide.operators.whole import whole_matrix  # noqa: E402
from pairtide.plans import catalog, panels, scenario  # noqa: E402
from pairtide.session import local_session  # noqa: E402

DAILY = PairSpec(lookback=30, lag=1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.range(1000).repartition(8).selectExpr("sum(id)").collect()
    seconds = {}

    def timed(name, build):
        began = time.perf_counter()
        frame = build()
        frame.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)

    def daily_edges(spec=DAILY):
        return scenario.rolling_edges(panels.name_day(spark, sf_dir), spec)

    timed("panel_name_day", lambda: panels.name_day(spark, sf_dir))
    timed("panel_brand_week", lambda: panels.brand_week(spark, sf_dir))
    # The shape of the published full run: daily rows, lookback 30, lag 1, every pair of 64 assets.
    timed("rolling_edges_full", daily_edges)
    timed("rolling_metrics_full", lambda: metrics.rolling_metrics(panels.name_day(spark, sf_dir), DAILY))
    timed("rolling_edges_120_days", lambda: scenario.rolling_edges(timeline.limit_days(panels.name_day(spark, sf_dir), 120), DAILY))
    timed("roles_full", lambda: roles.role_pairs(scenario.window_roles(panels.name_day(spark, sf_dir), DAILY, RoleSpec()), ["end_ts"]))
    timed("single_matrix_full", lambda: whole_matrix(panels.name_day(spark, sf_dir), PairSpec(method="ccf_auc", max_lag=10)))
    timed("signature_full", lambda: daily_edges(PairSpec(method="signature", lookback=30, signature_form="levy")))
    timed("spearman_full", lambda: daily_edges(PairSpec(lookback=30, correlation="spearman")))
    for name in (
        "bars_ohlc", "returns", "ccf_lag_pearson", "ccf_lag_kendall", "ccf_lag_dcor", "ccf_lag_mi", "ccf_auc", "ccf_max_lag",
        "signature_by_std", "universe_filtered", "gated_ffill", "metrics_timeseries", "metrics_common", "adaptive_lookback",
        "rewards", "features_topk", "features_all", "seed_stats", "bootstrap_ci", "kpis", "walk_forward", "placebo", "quality",
    ):
        timed(name, lambda q=catalog.QUERIES[name]: q(spark, sf_dir))
    windows_full = windows.rolling_windows(timeline.calendar(panels.name_day(spark, sf_dir)), DAILY).count()
    assets = panels.name_day(spark, sf_dir).agg(F.count_distinct("asset")).first()[0]
    sizes = {"windows": windows_full, "assets": assets, "edges": windows_full * assets * (assets - 1) // 2}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "full_run": {**sizes, "edges_per_second": round(sizes["edges"] / seconds["rolling_edges_full"])},
            }
        )
    )


if __name__ == "__main__":
    main()
