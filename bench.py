"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("returns_series", "bollinger", "macd", "pairwise_correlations", "vpin", "cross_sectional_sort",
            "volume_profile", "asof_trades_quotes", "trades_to_1s_bars", "classify_trades", "walk_book", "pnl_report",
            "journal_upsert", "component_var", "optimize", "garch11_fit")


def main() -> None:
    from barloom import catalog
    from barloom.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    spark = session("bench")
    qs = catalog.load().QUERIES
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for name in names:
        t = []
        for _ in range(runs):
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            t.append(time.time() - t0)
        times[name] = round(statistics.median(t), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
