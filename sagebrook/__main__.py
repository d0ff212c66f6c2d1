"""Command line: list the registered queries, run one, or score saved answers.

    python -m sagebrook list
    python -m sagebrook run hybrid_search /root/testdata/sf0.01 [--rows 20] [--out DIR]
    python -m sagebrook score answers.json --report report.txt
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import scoring
from .plans import registry

ANSWER = "q_id string, question string, expected string, actual string, category string, difficulty string, latency_s double"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sagebrook")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(registry.queries()))
    run.add_argument("data")
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--out")
    score = commands.add_parser("score")
    score.add_argument("answers")
    score.add_argument("--report", required=True)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        result = registry.queries()[args.query](spark, args.data)
        if args.out:
            result.write.mode("overwrite").parquet(args.out)
        else:
            result.show(args.rows, truncate=60)
    else:
        answers = spark.read.schema(ANSWER).json(args.answers, multiLine=True)
        print(scoring.report(scoring.score_answers(answers), args.report))


if __name__ == "__main__":
    main()
