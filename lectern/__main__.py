"""python -m lectern inspect|compile|lookup ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern")
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("inspect").add_argument("bundle")
    made = jobs.add_parser("compile")
    made.add_argument("books")
    made.add_argument("out")
    made.add_argument("--strict", action="store_true")
    at = jobs.add_parser("lookup")
    at.add_argument("bundle")
    at.add_argument("t", type=float, nargs="+")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    from lectern.plans import books
    from lectern.shared import ship

    ship(spark)

    if given.job == "inspect":
        books.inspect_bundle(spark, given.bundle).show(100, False)
    elif given.job == "lookup":
        books.active_spans(spark, given.bundle, spark.createDataFrame([(t,) for t in given.t], "t double")).show(100, False)
    else:
        for name, df in books.compile_books(spark, given.books, strict=given.strict).items():
            df.write.mode("overwrite").parquet(f"{given.out}/{name}")


if __name__ == "__main__":
    main()
