"""Command line: mechanisms, run, keygen, verify, infer-schema, demo.

    python -m veilspark.cli run --input x.csv --schema s.json --eps 2 --mechanism pairwise
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import ledger, release
from .schema import PublicSchema, infer_nonprivate
from .sources import tables


def _session() -> SparkSession:
    return SparkSession.builder.appName("veilspark").getOrCreate()


def _input(spark: SparkSession, args) -> tuple:
    if args.schema:
        with open(args.schema) as f:
            schema = PublicSchema.from_json(f.read())
        df = tables.from_csv(spark, args.input, schema, args.null)
    else:
        raw = spark.read.csv(args.input, header=True, inferSchema=True, ignoreLeadingWhiteSpace=True, nullValue=args.null).na.drop("any")
        schema = infer_nonprivate(raw)
        df = schema.project(raw)
    # rows have no key of their own: one of their content and count
    return df.withColumn("rid", F.monotonically_increasing_id()), schema


def run(args) -> int:
    spark = _session()
    df, schema = _input(spark, args)
    cells = [release.Cell(args.mechanism, eps, args.seed, canaries=args.canaries) for eps in args.eps]
    book = ledger.Ledger(spark, args.ledger) if args.ledger else None
    sheet = release.run_sweep(df, schema, cells, target=args.target, dataset=args.input, book=book) | {"schema_inferred_from_data": not args.schema}
    if args.sign:
        sheet = ledger.sign_sheet(spark, sheet, args.sign, args.sign.removesuffix(".key") + ".pub")
    text = json.dumps(sheet, sort_keys=True, indent=1)
    if args.output:
        with open(args.output, "w") as f:
            f.write(text)
    print(text)
    return 0


def verify(args) -> int:
    with open(args.sheet) as f:
        sheet = json.load(f)
    try:
        ledger.verify_sheet(_session(), sheet, args.key)
    except ledger.BadSignature as problem:
        print(f"not valid: {problem}", file=sys.stderr)
        return 1
    print("valid")
    return 0


def demo(args) -> int:
    spark = _session()
    toy = tables.toy(spark, args.rows, args.seed)
    schema = PublicSchema.from_dict({"columns": [{"name": "age", "kind": "numerical", "lower": 18, "upper": 70}, {"name": "income", "kind": "numerical", "lower": 0, "upper": 150000}, {"name": "category", "kind": "categorical", "categories": ["A", "B", "C"]}]})
    print(json.dumps(release.run_release(toy, schema, release.Cell("independent", args.eps, args.seed, canaries=20)), sort_keys=True, indent=1))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilspark")
    sub = parser.add_subparsers(required=True)
    sub.add_parser("mechanisms").set_defaults(do=lambda a: print("\n".join(sorted(release.ALL_MECHANISMS))) or 0)
    p = sub.add_parser("run")
    p.add_argument("--input", required=True)
    p.add_argument("--schema")
    p.add_argument("--eps", type=float, nargs="+", default=[1.0])
    p.add_argument("--mechanism", choices=sorted(release.ALL_MECHANISMS), default="pairwise")
    p.add_argument("--target")
    p.add_argument("--null", default="?")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--canaries", type=int, default=60)
    p.add_argument("--ledger")
    p.add_argument("--sign", help="private key file; the public one lies beside it")
    p.add_argument("--output")
    p.set_defaults(do=run)
    p = sub.add_parser("keygen")
    p.add_argument("folder")
    p.set_defaults(do=lambda a: print(*ledger.generate_keys(_session(), a.folder)) or 0)
    p = sub.add_parser("verify")
    p.add_argument("sheet")
    p.add_argument("--key", required=True, help="the public key that is expected")
    p.set_defaults(do=verify)
    p = sub.add_parser("infer-schema")
    p.add_argument("input")
    p.add_argument("--null", default="?")
    p.set_defaults(do=lambda a: print(infer_nonprivate(_session().read.csv(a.input, header=True, inferSchema=True, nullValue=a.null).na.drop("any")).to_json()) or 0)
    p = sub.add_parser("demo")
    p.add_argument("--rows", type=int, default=400)
    p.add_argument("--eps", type=float, default=1.0)
    p.add_argument("--seed", type=int, default=0)
    p.set_defaults(do=demo)
    args = parser.parse_args(argv)
    return args.do(args)


if __name__ == "__main__":
    sys.exit(main())
