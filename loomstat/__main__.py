"""Command line: ``run`` a configuration, ``meta``-analyse its results, ``summary`` of them in Markdown."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .operators import report
from .plans import runner
from .sources import results


def main() -> None:
    parser = argparse.ArgumentParser(prog="loomstat")
    sub = parser.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run")
    run.add_argument("--config", required=True)
    run.add_argument("--run", action="append")
    run.add_argument("--cwd", default=".")
    run.add_argument("--log")
    meta = sub.add_parser("meta")
    meta.add_argument("--results-dir", default="results")
    meta.add_argument("--output-dir", default="meta")
    meta.add_argument("--run", action="append")
    meta.add_argument("--inputs", nargs="+", help="these files instead of a folder's")
    meta.add_argument("--output", default="meta.csv", help="where the result of --inputs goes")
    meta.add_argument("--log")
    summary = sub.add_parser("summary")
    summary.add_argument("--results-dir", default="results")
    summary.add_argument("--meta-dir", default="meta")
    summary.add_argument("--log")
    summary.add_argument("--output")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, handlers=[logging.StreamHandler(), *([logging.FileHandler(args.log)] if args.log else [])])
    spark = SparkSession.builder.appName("loomstat").getOrCreate()
    if args.what == "run":
        runner.run_all(spark, args.config, args.cwd, args.run)
    elif args.what == "meta" and args.inputs:
        runner.meta_explicit(spark, args.inputs, args.output)
    elif args.what == "meta":
        runner.meta_all(spark, args.results_dir, args.output_dir, args.run)
    else:
        text = report.summary(results.read_results(spark, results.discover(spark, args.results_dir)), results.read_meta(spark, results.discover(spark, args.meta_dir, meta=True)))
        if args.output:
            with open(args.output, "w") as f:
                f.write(text)
        else:
            print(text)


if __name__ == "__main__":
    main()
