"""python -m quoin --db FOLDER init | ingest | watch | delete | stats | inspect: thin drivers over the plans."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quoin.operators import layout, reports, store
from quoin.plans import ingest
from quoin.settings import Settings
from quoin.sources import files as sources
from quoin.streaming.ingest import ingest_uploads


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quoin")
    p.add_argument("--db", required=True, help="folder of the tables, which all executors see")
    to = p.add_subparsers(dest="command", required=True)
    to.add_parser("init", help="write empty tables")
    run = to.add_parser("ingest", help="process issues, as documents with a decoder or as tables of blocks and pages")
    run.add_argument("--documents", help="folder or file")
    run.add_argument("--decoder", help="module with the functions spans and pages, from a document's bytes to rows")
    for name in ("files", "blocks", "pages"):
        run.add_argument(f"--{name}", help="Parquet folder")
    run.add_argument("--models", required=True, help="module:function that returns plans.ingest.Models")
    run.add_argument("--date", help="issue date, where it is known")
    watch = to.add_parser("watch", help="process documents as they are uploaded to a folder, each once")
    watch.add_argument("--documents", required=True)
    watch.add_argument("--decoder", required=True)
    watch.add_argument("--models", required=True)
    watch.add_argument("--checkpoint", help="folder that remembers what was handled")
    watch.add_argument("--forever", action="store_true", help="wait for more instead of ending with what is there")
    gone = to.add_parser("delete", help="delete the issue of a date")
    gone.add_argument("date")
    to.add_parser("stats", help="a row for each issue")
    look = to.add_parser("inspect", help="sizes and scanned pages of blocks")
    look.add_argument("--blocks", required=True)
    look.add_argument("--pages", required=True)
    args = p.parse_args(argv)

    spark = SparkSession.builder.appName("quoin").getOrCreate()
    db = store.Store(spark, args.db)
    if args.command == "init":
        db.init()
    elif args.command == "watch":
        module, _, function = args.models.partition(":")
        decoder, models = importlib.import_module(args.decoder), getattr(importlib.import_module(module), function)()
        query = ingest_uploads(db, args.documents, decoder.spans, decoder.pages, models, Settings.load(spark), args.checkpoint or f"{args.db}/uploads", once=not args.forever)
        query.awaitTermination()
    elif args.command == "ingest":
        module, _, function = args.models.partition(":")
        if bool(args.documents) != bool(args.decoder) or not args.documents and not (args.files and args.blocks and args.pages):
            p.error("give --documents and --decoder, or --files, --blocks and --pages")
        decoder = importlib.import_module(args.decoder) if args.documents else None
        files, pages, blocks = ingest.decoded(db, sources.files(spark, args.documents), decoder.spans, decoder.pages) if decoder else (spark.read.parquet(args.files), sources.pages(spark, args.pages), sources.blocks(spark, args.blocks))
        files = files.select("issue", "filename", "pdf_sha256")
        if args.date:
            files = files.withColumn("issue_date", F.lit(args.date).cast("date"))
        models = getattr(importlib.import_module(module), function)()
        ingest.process(db, files, pages, blocks, models, Settings.load(spark), progress=print).show(truncate=False)
    elif args.command == "delete":
        names = ("issues", "articles", "extractions", "feedback")
        day = F.lit(args.date).cast("date")
        ids = [r.id for r in db.table("issues").filter(F.col("issue_date") == day).select("id").collect()]  # one a date
        db.commit(store.delete_date({n: db.table(n, ids) if n in store.PARTS else db.table(n) for n in names}, day), ids)
    elif args.command == "stats":
        reports.issue_stats(db.table("issues"), db.table("articles"), db.table("extractions")).orderBy(F.desc("issue_date")).show(truncate=False)
    else:
        blocks = sources.blocks(spark, args.blocks)
        layout.font_histogram(blocks).orderBy("issue", "rank").show(100, truncate=False)
        layout.scanned_pages(sources.pages(spark, args.pages), blocks).orderBy("issue", "page").show(100, truncate=False)


if __name__ == "__main__":
    main()
