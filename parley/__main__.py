"""Run registered queries from the command line.

    python -m parley list
    python -m parley run agent_profile --sf-dir /root/testdata/sf0.01 --out /path/out --format json
    python -m parley show weighted_scores --sf-dir /root/testdata/sf0.001 -n 20

``run`` writes the whole result with Spark's writers (no driver collect);
``show`` prints the first rows for a look.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m parley")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered queries")
    for name in ("run", "show"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--sf-dir", default="/root/testdata/sf0.01")
        s.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
        if name == "run":
            s.add_argument("--out", required=True)
            s.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
        else:
            s.add_argument("-n", type=int, default=20)
    args = p.parse_args(argv)

    from parley.plans.queries import QUERIES
    if args.cmd == "list":
        for q in QUERIES:
            print(q)
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; see `python -m parley list`", file=sys.stderr)
        return 2
    from parley.session import build_session
    spark = build_session(args.master)
    df = QUERIES[args.query](spark, args.sf_dir)
    if args.cmd == "run":
        df.write.mode("overwrite").format(args.format).save(args.out)
    else:
        df.show(args.n, truncate=60)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
