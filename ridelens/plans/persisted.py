"""Persisted-tables run: clean once, persist, run every report on the persisted tables.

This is how the reports run in production (and what the reference does with its
cleaned CSV): the cleaning job's output and the region table are written as
Parquet into the shared folder named by ``spark.checkpoint.dir`` (never a
machine-local temp folder), which cuts the lineage – a lost executor recomputes
from those files, not from the raw joins – and lets every report prune columns
and push filters into the scan. Reports that only count rows, or sum fares, per small keys read counted rows
(:mod:`ridelens.plans.cube`) and not the fact rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridelens.operators import geo as G
from ridelens.operators import profile as PF
from ridelens.operators import time as TM
from ridelens.plans import reports as R
from ridelens.plans.cube import CLEAN_SLICES, REGION_SLICES, counted, slice_of
from ridelens.sources.driver_views import bookings, bookings_clean, locations
from ridelens.sources.files import persist_table, write_table


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None,
                base: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back."""
    return persist_table(df, name, partition_by, base)


def build_tables(spark: SparkSession, sf_dir: str, base: str | None = None) -> dict[str, DataFrame]:
    """Raw view, cleaned table (partitioned by month), region table and the counted rows of both, persisted. The counted
    rows are ``clean/<slice>`` and ``region/<slice>``.

    In the shared checkpoint folder each run has names of its own, so two runs never
    overwrite each other; in a folder given as ``base`` the names are fixed.
    """
    tag = "" if base else f"_{uuid.uuid4().hex[:12]}"
    raw = materialize(bookings(spark, sf_dir), f"bookings_raw{tag}", base=base)
    clean = materialize(bookings_clean(spark, sf_dir), f"bookings_clean{tag}", ["month"], base=base)
    region = materialize(G.region_bookings(clean, locations(spark, sf_dir)), f"bookings_region{tag}", base=base)
    out = {"raw": raw, "clean": clean, "region": region}
    for name, slices in (("clean", CLEAN_SLICES), ("region", REGION_SLICES)):
        cells = materialize(counted(out[name], slices, fares=name == "region"), f"bookings_{name}_counted{tag}",
                            ["slice"], base=base)
        out |= {f"{name}/{s}": slice_of(cells, slices, s) for s in slices}
    return out


# report name → (table key, report function)
REPORTS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "value_distribution": ("clean", R.value_distribution),
    "value_kpis": ("clean", R.value_kpis),
    "tail_share": ("clean", R.value_tail),
    "status_mix": ("clean/status", R.status_mix),
    "friction_report": ("clean/status", R.friction_report),
    "top_reasons_customer": ("clean/customer_reason", lambda d: R.top_reasons(d, "reason_for_cancelling_by_customer")),
    "top_reasons_driver": ("clean/driver_reason", lambda d: R.top_reasons(d, "driver_cancellation_reason")),
    "vehicle_summary": ("clean", R.vehicle_summary),
    "vehicle_kpis": ("clean", R.vehicle_kpis),
    "segment_share": ("clean", R.segment_share),
    "distance_bins": ("clean", R.distance_bins),
    "wait_bins": ("clean", R.wait_bins),
    "distance_wait_joint": ("clean", R.distance_wait_joint),
    "trip_kpis": ("clean", R.trip_kpis),
    "slowest_bin": ("clean", R.slowest_bin),
    "demand_hour": ("clean/time", lambda d: TM.demand_by(d, "hour")),
    "demand_weekday": ("clean/time", lambda d: TM.demand_by(d, "weekday")),
    "demand_month": ("clean/time", lambda d: TM.demand_by(d, "month")),
    "demand_kpis": ("clean/time", TM.demand_kpis),
    "peak_shares": ("clean/time", lambda d: TM.peak_shares(d)),
    "payment_mix": ("clean/payment", R.payment_mix),
    "ratings_distribution": ("clean", R.ratings_distribution),
    "low_rating_share": ("clean", R.low_rating_share),
    "ratings_kpis": ("clean", R.ratings_kpis),
    "uplift": ("clean", R.uplift),
    "top_pickups": ("region/pickup", lambda d: R.top_locations(d, "pickup_location")),
    "top_drops": ("region/drop", lambda d: R.top_locations(d, "drop_location")),
    "heatmap_weekday_hour": ("region/time", TM.heatmap_weekday_hour),
    "heatmap_topzone_hour": ("region/pickup", R.heatmap_topzone_hour),
    "service_quality": ("region", R.service_quality),
    "service_bins_trimmed": ("region", R.service_bins),
    "zone_service": ("region", R.zone_service),
    "revenue_kpis": ("region", lambda d: R.zone_kpis(d, by_zone=False)),
    "zone_kpis": ("region", R.zone_kpis),
    "revenue_by_zone": ("region/pickup", R.revenue_by_zone),
    "top5_zone_share": ("region/pickup", R.top_zone_share),
    "revenue_value_bins": ("region", R.revenue_value_bins),
    "arpu_by_hour": ("region/pickup", R.arpu_by_hour),
    "arpu_by_zone_hour": ("region/pickup", R.arpu_by_zone_hour),
    "zone_options": ("region/pickup", R.zone_options),
    "vehicle_mix": ("region", R.vehicle_mix),
    "mix_kpis": ("region", R.mix_kpis),
    "distance_vs_wait_median": ("region", R.distance_vs_wait_median),
    "column_profile": ("raw", PF.profile),
    "missing_report": ("raw", PF.missing_report),
    "duplicate_count": ("raw", PF.duplicate_count),
    "vehicle_summary_text": ("raw", R.vehicle_summary_text),
}


def run_reports(tables: dict[str, DataFrame], names: list[str] | None = None) -> dict[str, DataFrame]:
    """Lazy report DataFrames over the persisted tables."""
    return {n: fn(tables[key]) for n, (key, fn) in REPORTS.items() if names is None or n in names}


def run_persisted_reports(spark: SparkSession, sf_dir: str, out_dir: str, names: list[str] | None = None) -> list[str]:
    """Build the tables once and write every report as Parquet under ``out_dir``."""
    tables = build_tables(spark, sf_dir)
    written = []
    for name, df in run_reports(tables, names).items():
        # no coalesce(1): it would pull the final aggregate stage into one task
        write_table(df, f"{out_dir.rstrip('/')}/{name}")
        written.append(name)
    return written


def main(argv: list[str] | None = None) -> None:
    """``python -m ridelens.plans.persisted --sf DIR --out DIR [--master local[8]] [report ...]``"""
    import argparse

    from ridelens.session import get_session

    ap = argparse.ArgumentParser(description="clean once, persist, write every report")
    ap.add_argument("--sf", required=True, help="folder with the input tables")
    ap.add_argument("--out", required=True, help="output folder for the report tables")
    ap.add_argument("--master", default=None, help="only for local runs; a cluster submit sets its own")
    ap.add_argument("reports", nargs="*")
    a = ap.parse_args(argv)
    spark = get_session(a.master)
    for name in run_persisted_reports(spark, a.sf, a.out, a.reports or None):
        print(name)


if __name__ == "__main__":
    main()
