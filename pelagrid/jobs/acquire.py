"""Store a subset of a catalogued data set:

spark-submit pelagrid/jobs/acquire.py --catalog products.json --output /shared/salt \\
    --dataset ocean_daily --variables so --longitude -75 -35 --latitude -10 30 \\
    --depth 0.494 0.494 --years 2000 2020
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pelagrid import Catalog, build_session, subset


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Store a subset of a data set, by year.")
    parser.add_argument("--catalog", required=True, help="JSON text file of the data sets, readable by Spark")
    parser.add_argument("--output", required=True, help="directory for the subset")
    parser.add_argument("--name", help="name of the subset; made from the request if left out")
    parser.add_argument("--dataset", required=True)
    parser.add_argument("--variables", nargs="+")
    for dim in ("longitude", "latitude", "depth"):
        parser.add_argument(f"--{dim}", nargs=2, type=float, default=(None, None), metavar=("LOW", "HIGH"))
    parser.add_argument("--start")
    parser.add_argument("--end")
    parser.add_argument("--years", nargs=2, type=int, metavar=("FIRST", "LAST"), help="one request per year, both included")
    parser.add_argument("--keep", action="store_true", help="leave an existing subset as it is")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> str:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    args = arguments(argv)
    spark = build_session("pelagrid-acquire")
    text = "\n".join(r.value for r in spark.read.text(args.catalog, wholetext=True).collect())
    return subset(
        spark, Catalog.from_json(text), args.output, args.name, force_download=not args.keep,
        years=range(args.years[0], args.years[1] + 1) if args.years else None,
        dataset_id=args.dataset, variables=args.variables,
        minimum_longitude=args.longitude[0], maximum_longitude=args.longitude[1],
        minimum_latitude=args.latitude[0], maximum_latitude=args.latitude[1],
        minimum_depth=args.depth[0], maximum_depth=args.depth[1],
        start_datetime=args.start, end_datetime=args.end,
    )


if __name__ == "__main__":
    main()
