"""Nightly run from the command line.

    spark-submit ... -m updraft --store DIR --universe CSV --out DIR \\
        [--quotes PARQUET] [--now ISO] [--metric=turnover] [--no-fetch]

``--quotes`` holds rows (code, date, open, close, volume, seq).
"""

from __future__ import annotations

import argparse
import datetime as dt

from updraft.config import options_from_flags
from updraft.plans.nightly import run_nightly
from updraft.session import build_session
from updraft.sinks.price_store import PriceStore
from updraft.sources.universe import read_universe


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="updraft", description=__doc__)
    parser.add_argument("--store", required=True)
    parser.add_argument("--universe", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--quotes")
    parser.add_argument("--batch-id")
    parser.add_argument("--now", type=dt.datetime.fromisoformat, default=None)
    args, flags = parser.parse_known_args(argv)
    cfg, ingest = options_from_flags(flags)
    now = args.now or dt.datetime.now()

    spark = build_session()
    run = run_nightly(
        PriceStore(spark, args.store), read_universe(spark, args.universe), args.out, now, cfg,
        quotes=spark.read.parquet(args.quotes) if ingest and args.quotes else None,
        batch_id=args.batch_id,
    )
    top = run.header.first()
    print(
        f"{top['hits']} hits (tier 1: {top['tier1']}, tier 2: {top['tier2']}), "
        f"{top['codes']} codes, data to {run.latest}, current: {run.is_current}"
    )
    if top["stale_note"]:
        print(top["stale_note"])


if __name__ == "__main__":
    main()
