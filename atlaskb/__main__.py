"""Command line: python -m atlaskb sync MODE | index | inbox | cleanup | stats, on a knowledge base's folder."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession

from . import jobs
from .config import Settings
from .operators import store
from .sources import fetch


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="atlaskb", description=__doc__)
    out.add_argument("--root", required=True, help="folder of the knowledge base")
    out.add_argument("--settings", help="JSON file of overrides")
    commands = out.add_subparsers(dest="command", required=True)
    sync = commands.add_parser("sync", help="crawl and index")
    sync.add_argument("mode", choices=jobs.MODES)
    sync.add_argument("--urls", help="file of URLs to fetch, one a line")
    sync.add_argument("--fetcher", default="http", choices=sorted(fetch.FETCHERS))
    sync.add_argument("--inbox")
    index = commands.add_parser("index", help="index the pages and PDFs of the crawl")
    index.add_argument("--reset", action="store_true")
    only = index.add_mutually_exclusive_group()
    only.add_argument("--only-html", action="store_true")
    only.add_argument("--only-pdf", action="store_true")
    commands.add_parser("inbox", help="take in new documents").add_argument("folder")
    commands.add_parser("cleanup", help="drop excluded URLs").add_argument("--dry-run", action="store_true")
    commands.add_parser("stats", help="size of the store by kind")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    settings = Settings.from_env(file=".env")
    if args.settings:
        with open(args.settings, encoding="utf-8") as f:
            settings = settings.with_overrides(f.read())
    base = jobs.Base(spark, args.root, settings, now=datetime.datetime.now().isoformat(timespec="seconds"))
    if args.command == "sync":
        fetched = None
        if args.urls:
            spark.dataSource.register(fetch.SiteSource)
            urls = spark.read.text(args.urls)
            listed = "\n".join(r.value for r in urls.toLocalIterator())
            fetched = spark.read.format("site").option("urls", listed).option("fetcher", args.fetcher).load()
        jobs.sync(base, args.mode, fetched, args.inbox).show()
    elif args.command == "index":
        if args.reset:
            base.write("store", base.read("store").limit(0))
        if not args.only_pdf:
            jobs.index_documents(base, jobs.page_documents(base.read("pages")), skip_existing=not args.reset).show()
        if not args.only_html and jobs.has_documents(base):
            jobs.index_documents(base, jobs.pdf_documents(base, base.read("pdfs")), skip_existing=not args.reset).show()
        jobs.reindex(base)
    elif args.command == "inbox":
        jobs.inbox_tallies(jobs.take_inbox(base, args.folder)).show()
    elif args.command == "cleanup":
        found = jobs.clean_up(base, args.dry_run)
        found["counts"].show()
        found["sample"].show(truncate=False)
    else:
        store.chunks_by_kind(base.read("store")).show()


if __name__ == "__main__":
    main()
