"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is planned and run to the end (noop sink, all rows and columns).
``price_x3_*`` runs on three disjoint copies of the line items, about the
row count of the published study (1.9 million), so its sweep and feature times
can be read beside the published ones. ``fares_x25_feature_frame`` builds the whole frame,
calendar and itinerary features included, from 25 copies of the fare observations.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from faretrace.fixtures import FARE_TRAJECTORY, FIXTURE, PRICE_TRAJECTORY, fare_obs, price_obs  # noqa: E402
from faretrace.operators import features, spikes  # noqa: E402
from faretrace.session import build_session  # noqa: E402
from faretrace.sources.ingest import clean  # noqa: E402
from registry import SPARK  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

REGISTERED = [
    "l6_summary_by_route", "w1_w2_rolling_price", "l7_window_sweep", "l7_window_sweep_price",
    "l8_sigma_table", "e4_feature_frame", "e7_encoded_design", "a1_describe_price_by_flag",
    "a5_route_summary", "a20_cadence_summary", "a21_change_sizes", "a30_airline_summary",
    "a34_fare_histogram", "j1_semi_join_keys", "v6_leakage_orders", "v7_describe_folds",
    "m4_roc_auc_orders", "m9_best_threshold", "m10_regression_errors_price",
    "m11_model_comparison",
]


def price_times_three(spark) -> DataFrame:
    copies = price_obs(spark, SF_DIR).selectExpr(
        "*", "explode(array(0L, 1000000000L, 2000000000L)) AS shift")
    return copies.selectExpr("legId + shift AS legId", "* EXCEPT (legId, shift)")


def sweep_x3(spark, _) -> DataFrame:
    return spikes.sweep_windows(price_times_three(spark), PRICE_TRAJECTORY)


def features_x3(spark, _) -> DataFrame:
    rows = price_times_three(spark)
    labelled = spikes.detect_spikes(rows, PRICE_TRAJECTORY, FIXTURE)
    return features.add_lagged_features(labelled, PRICE_TRAJECTORY)


def feature_frame_x25(spark, _) -> DataFrame:
    copies = fare_obs(spark, SF_DIR).selectExpr("*", "explode(sequence(1, 25)) AS copy")
    moved = copies.selectExpr("concat(legId, '/', copy) AS legId", "* EXCEPT (legId, copy)")
    return features.observations_to_features(clean(moved), FARE_TRAJECTORY, FIXTURE)


def main() -> None:
    spark = build_session("bench", CPUS, CPUS)
    todo = {name: SPARK[name] for name in REGISTERED}
    todo |= {"price_x3_window_sweep": sweep_x3, "price_x3_labels_and_lags": features_x3,
             "fares_x25_feature_frame": feature_frame_x25}
    SPARK["s12_shape"](spark, SF_DIR).collect()  # start the executor threads once
    seconds = {}
    for name, fn in todo.items():
        begun = time.perf_counter()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_query_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
