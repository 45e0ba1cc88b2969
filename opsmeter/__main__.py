"""spark-submit entry: ``tickets``, ``quality`` or ``sales``."""

from __future__ import annotations

import argparse
from datetime import datetime

from opsmeter.plans import runs
from opsmeter.session import build_session
from opsmeter.sources.star import read_star


def main() -> None:
    parser = argparse.ArgumentParser(prog="opsmeter")
    jobs = parser.add_subparsers(dest="job", required=True)
    ticket_job = jobs.add_parser("tickets")
    ticket_job.add_argument("source")
    quality_job = jobs.add_parser("quality")
    quality_job.add_argument("customers")
    quality_job.add_argument("transactions")
    quality_job.add_argument("--as-of", type=datetime.fromisoformat, default=None)
    sales_job = jobs.add_parser("sales")
    sales_job.add_argument("source")
    sales_job.add_argument("--source-format", default="parquet")
    for job in (ticket_job, quality_job):
        job.add_argument(
            "--single-line", action="store_true", help="no quoted line breaks: spares the look for them"
        )
        job.add_argument(
            "--bad-share",
            type=float,
            default=None,
            help="go on without records whose cells do not fit, up to this share of an input",
        )
    for job in (ticket_job, quality_job, sales_job):
        job.add_argument("target")
        job.add_argument("--format", default="csv")
    args = parser.parse_args()

    spark = build_session()
    multi_line = False if getattr(args, "single_line", False) else None
    if args.job == "tickets":
        runs.run_tickets(spark, args.source, args.target, args.format, multi_line, args.bad_share)
    elif args.job == "quality":
        # one moment for the whole run
        as_of = args.as_of or datetime.now()
        runs.run_quality(
            spark,
            args.customers,
            args.transactions,
            args.target,
            as_of,
            args.format,
            multi_line,
            args.bad_share,
        )
    else:
        star = read_star(spark, args.source, args.source_format)
        runs.run_sales(star, args.target, args.format)
        runs.sanity_checks(star, args.target, args.format)
    spark.stop()


if __name__ == "__main__":
    main()
