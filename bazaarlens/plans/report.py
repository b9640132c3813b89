"""All analyses over the stored tables, one CSV folder each."""

from __future__ import annotations

import argparse

from functools import partial
from uuid import uuid4

from pyspark.sql import SparkSession

from bazaarlens.params import Params
from bazaarlens.plans.datasets import Datasets, stored
from bazaarlens.plans.registry import JOBS
from bazaarlens.session import build_session, remove_dir, shared_dir
from bazaarlens.sources.results import export_csv
from bazaarlens.sources.warehouse import StoredMarketplace

# Results with one row per seller: written by as many tasks as they were sorted in.
SELLER_RESULTS = frozenset(
    {
        "j2_3_top_offenders",
        "j2_5_seller_quarters_filtered",
        "j2_6_seller_segments",
        "j2_10_action_list",
    }
)


def write_report(datasets: Datasets, out_dir: str, names: list[str] | None = None) -> None:
    """Run the named analyses (all unless named). Give ``datasets`` ``keep=stored`` to share what they share."""
    for name in names or JOBS:
        export_csv(JOBS[name](datasets), f"{out_dir}/{name}", single_file=name not in SELLER_RESULTS)


def run_report(
    spark: SparkSession, warehouse_dir: str, out_dir: str, params: Params | None = None, names: list[str] | None = None
) -> None:
    """A report over the stored tables. What the analyses share is stored meanwhile, and deleted at the end."""
    folder = f"{shared_dir(spark)}/report-{uuid4().hex}"
    tables = StoredMarketplace(spark, warehouse_dir)
    try:
        write_report(Datasets(tables, params or Params(), keep=partial(stored, folder=folder)), out_dir, names)
    finally:
        remove_dir(spark, folder)


def main() -> None:
    parser = argparse.ArgumentParser(description="Write every analysis as CSV.")
    parser.add_argument("warehouse_dir")
    parser.add_argument("out_dir")
    parser.add_argument("names", nargs="*", help="analyses to run; all if none is named")
    parser.add_argument("--shuffle-gb", type=int, help="size of the largest shuffle expected")
    args = parser.parse_args()
    spark = build_session("bazaarlens-report", shuffle_gb=args.shuffle_gb)
    run_report(spark, args.warehouse_dir, args.out_dir, names=args.names)


if __name__ == "__main__":
    main()
