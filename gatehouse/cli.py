"""python -m gatehouse.cli: profile, gate, curate and report over JSON lines, and the acceptance scenarios."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.functions.text import features
from gatehouse.operators import outliers, report
from gatehouse.operators.cascade import curate
from gatehouse.operators.gates import GATES
from gatehouse.sources.adapters import as_documents, read_jsonl


def _text(spark: SparkSession, text: str, kind: str = "text") -> DataFrame:
    one = spark.createDataFrame([(text,)], "text string")
    return as_documents(one, F.lit("cli"), F.col("text"), F.lit("cli"), F.lit(kind), F.col("text"))


def _show(df: DataFrame, limit: int) -> None:
    for line in df.limit(limit).toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="gatehouse", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("profile", "curate", "report", "outliers"):
        s = sub.add_parser(name)
        s.add_argument("path", help="JSON lines with id, text, source, modality, raw")
        s.add_argument("--limit", type=int, default=20, help="rows shown")
    s = sub.add_parser("gate")
    s.add_argument("kind", choices=sorted(GATES))
    s.add_argument("text")
    s = sub.add_parser("experiments")
    s.add_argument("names", nargs="*")
    s.add_argument("--out", help="folder for a JSON file of each scenario and one of all")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("gatehouse").getOrCreate()
    if args.command == "gate":
        got = GATES[args.kind].evaluate(_text(spark, args.text, args.kind))
        _show(got.select("gate_quality", "gate_passed", "gate_flags", *[f"s_{k}" for k in GATES[args.kind].weights]), 1)
    elif args.command == "experiments":
        from gatehouse.plans.experiments import ALL

        found = {}
        for name in args.names or ALL:
            found[name] = ALL[name](spark)
            print(json.dumps({name: found[name]}, default=str))
        if args.out:
            Path(args.out).mkdir(parents=True, exist_ok=True)
            for name, value in {**found, "summary": found}.items():
                Path(args.out, f"{name}.json").write_text(json.dumps(value, default=str, indent=1))
    else:
        docs = read_jsonl(spark, args.path)
        if args.command == "report":
            print(report.markdown(curate(docs)))
        elif args.command == "curate":
            _show(curate(docs).drop("text", "raw"), args.limit)
        elif args.command == "outliers":
            _show(outliers.profile(features(docs)).where("is_outlier"), args.limit)
        else:
            _show(features(docs).drop("text", "raw"), args.limit)


if __name__ == "__main__":
    main()
