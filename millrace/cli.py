"""python -m millrace.cli ROOT corpora | queries | mixtures | datasets | executions | profile NAME | preview NAME [--json]: a look at captured corpora."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from millrace.sources.snapshots import RECORDS, Catalog


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("root")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("corpora", *RECORDS):
        sub.add_parser(name)
    for name in ("profile", "snapshots", "preview"):
        sub.add_parser(name).add_argument("name")
    a = p.parse_args(args)
    catalog = Catalog(spark or SparkSession.builder.getOrCreate(), a.root)
    if a.what == "corpora":
        rows = [{"corpus": c, "snapshot": catalog.latest(c)} for c in catalog.corpora()]
    elif a.what in RECORDS:
        rows = catalog.listing(a.what, 1000)
    elif a.what == "preview":
        rows = [{"source_key": r["source_key"], "text": r["text"][:200]} for r in catalog.open(a.name).orderBy("source_key").limit(10).collect()]
    else:
        rows = catalog.snapshots(a.name) if a.what == "snapshots" else [catalog.manifest(a.name)]
    for r in rows:
        print(json.dumps(r, ensure_ascii=False, sort_keys=True) if a.json else "  ".join(f"{k}={v}" for k, v in r.items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
