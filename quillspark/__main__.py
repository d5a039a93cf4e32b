"""``python -m quillspark ingest|ask``: the two pipelines from the command line.

Settings come from arguments, else from the environment (``QUILL_TABLE``, ``QUILL_LOG``, in either case).
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession


def setting(name: str, default: str | None = None) -> str | None:
    return os.environ.get(name.lower()) or os.environ.get(name.upper()) or default


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("--table", default=setting("quill_table", "quill-artifacts"))
    p.add_argument("--log", default=setting("quill_log", "quill-ingest-log"))
    commands = p.add_subparsers(dest="command", required=True)
    i = commands.add_parser("ingest", help="take in the labels of drugs from folders of JSON answers")
    i.add_argument("--drug", action="append", default=[])
    i.add_argument("--set", help="a file with one name per line")
    i.add_argument("--limit", type=int)
    i.add_argument("--reset-checkpoint", action="store_true")
    i.add_argument("--answers", required=True, help="a folder with the folders concepts, classes and labels")
    a = commands.add_parser("ask", help="gather the evidence for a question")
    a.add_argument("question")
    a.add_argument("--rounds", type=int, default=3)
    a.add_argument("--year", type=int, required=True)
    o = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    if o.command == "ingest":
        from quillspark.plans.ingestion import Sources, ingest_names
        from quillspark.sources.labels import from_files

        names = [*o.drug, *(open(o.set, encoding="utf-8").read().splitlines() if o.set else [])]
        folder = lambda kind: lambda wanted: from_files(spark, f"{o.answers}/{kind}").where(f"name in ({', '.join(map(repr, wanted)) or 'null'})")
        report = ingest_names(spark, names, Sources(folder("concepts"), folder("classes"), folder("labels")), o.table, o.log, o.limit, o.reset_checkpoint)
    else:
        from quillspark import schema
        from quillspark.operators.assemble import summary
        from quillspark.plans.engine import Engine

        evidence, rounds, intent = Engine(spark, spark.read.schema(schema.INDEX).parquet(o.table), o.year).ask(o.question, o.rounds)
        report = {"type": intent.query_type, "layouts": list(intent.layouts), "rounds": rounds, "sections": {r.section: r.nodes for r in summary(evidence).collect()}}
    print(json.dumps(report, default=str))
    return report


if __name__ == "__main__":
    main()
