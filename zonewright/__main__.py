"""Run a job from a JSON job configuration.

``python -m zonewright chain <app_config> <dataset> <data_path>``
Session settings come from ``spark-submit`` or the Spark defaults.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from zonewright.operators.quality import assert_passed, settle
from zonewright.plans.jobs import (
    ingest,
    raw_to_staging,
    run_chain,
    validate_raw,
    validate_staging,
)
from zonewright.plans.spec import JobSpec, load_config


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="zonewright")
    parser.add_argument(
        "job", choices=["ingest", "validate-raw", "stage", "validate-staging", "chain"]
    )
    parser.add_argument("app_config", help="path of the JSON job configuration")
    parser.add_argument("dataset")
    parser.add_argument("data_path", help="path of the dataset below each zone")
    parser.add_argument("--as-of", default=dt.date.today().isoformat())
    parser.add_argument("--mode", default="errorifexists")
    parser.add_argument("--salt")
    parser.add_argument("--drop-raw", action="store_true")
    parser.add_argument("--on-cast-error", default="raise")
    parser.add_argument("--may-differ", nargs="*", default=(), help="columns, see reconcile")
    parser.add_argument("--lookup-distinct", action="store_true")
    parser.add_argument("--lookup-keys", nargs="*", default=())
    parser.add_argument("--lookup-order-by", nargs="*", default=())
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"zonewright-{args.job}").getOrCreate()
    spec = JobSpec.from_config(
        load_config(spark, args.app_config),
        args.dataset,
        lookup_distinct=args.lookup_distinct,
        lookup_keys=tuple(args.lookup_keys),
        lookup_order_by=tuple(args.lookup_order_by),
    )
    how = {"drop_raw": args.drop_raw, "salt": args.salt, "on_cast_error": args.on_cast_error}
    if args.job == "ingest":
        ingest(spark, spec, args.data_path, args.mode)
    elif args.job == "stage":
        raw_to_staging(spark, spec, args.data_path, args.as_of, args.mode, **how)
    elif args.job == "chain":
        may_differ = tuple(args.may_differ)
        run_chain(spark, spec, args.data_path, args.as_of, args.mode, **how, may_differ=may_differ)
    elif args.job == "validate-raw":
        _check(validate_raw(spark, spec, args.data_path))
    else:
        _check(validate_staging(spark, spec, args.data_path, args.drop_raw, args.may_differ))


def _check(report: DataFrame) -> None:
    report = settle(report)
    report.show(report.count(), truncate=False)
    assert_passed(report)


if __name__ == "__main__":
    main()
