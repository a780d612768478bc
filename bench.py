"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from areaweek.fixtures import FIT_END, WEEKS, Domain  # noqa: E402
from areaweek.operators import panel as p  # noqa: E402
from areaweek.operators.pointprocess import HawkesParameters  # noqa: E402
from areaweek.plans.features import build_panel  # noqa: E402
from areaweek.session import build_session  # noqa: E402
from areaweek.verification import registered  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CHECKED = (
    "panel_slice", "panel_full", "w1_own_event_lags", "h6_log_likelihood", "h8_intensity_features", "m12_evaluate", "w10_ranks", "a7_actor_edges",
    "b1_alert_decisions", "b5_brief_lines", "x4_resolve_places", "x5_money", "x7_threat", "s6_page_text", "j6_assign_units", "s13_upsert",
)


def customer_panel(spark, sf_dir):
    """Every feature for every customer as a unit: the size of the published panel at sf0.01, ten times it at sf0.1."""
    d = Domain(spark, sf_dir, large=True)
    return build_panel(d.incidents, d.registry, d.adjacency, WEEKS, hawkes=HawkesParameters(0.6, 0.5, 0.8, 0.03), fit_end=FIT_END)


def customer_windows(spark, sf_dir):
    d = Domain(spark, sf_dir, large=True)
    dense = p.dense_facts([p.weekly_events(d.incidents)], d.registry, ("events", "fatalities", "operations"), WEEKS)
    return dense.select("lga_code", "week_start", *[p.lag_sum("events", n).alias(f"own_events_{n}w") for n in p.OWN_EVENT_WEEKS])


def run(df) -> None:
    """Compute every column of every row, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", "bench", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="20g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = {name: registered()[name] for name in CHECKED}
    every |= {"customer_panel": customer_panel, "customer_windows": customer_windows}
    # Start-up and class loading are not part of any query.
    run(every["panel_slice"](spark, SF_DIR))
    seconds = {}
    for name, fn in every.items():
        start = time.time()
        run(fn(spark, SF_DIR))
        seconds[name] = round(time.time() - start, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
