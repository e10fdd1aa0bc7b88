"""Command line: build, update, search, similar, status, compact, cite, serve."""

from __future__ import annotations

import argparse
import json
import textwrap

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.cite import abs_url, biblatex
from .functions.text import latex_to_unicode, squash
from .operators import search as S
from .operators.derived import SEARCH_VIEW, newest, refresh_all
from .operators.embed import HashingEmbedder, embed_query
from .operators.filters import valid_date
from .operators.rerank import OverlapReranker
from .operators.store import Store
from .schema import DEFAULT_K, MAX_PAGES, SCOPE
from .serving import ResidentView, server
from .sources.snapshot import scan_snapshot
from .streaming.update import update


def formatted(hits, full: bool = False, scores: bool = False) -> list[str]:
    """At most k hits as lines for a terminal."""
    shown = hits.select("*", squash(F.col("title")).alias("_title"), latex_to_unicode("authors").alias("_names"), abs_url(F.col("id")).alias("_url"), squash(F.col("abstract")).alias("_text"))
    lines = []
    for n, r in enumerate(shown.collect(), 1):
        head = ""
        if scores and r["score"] is not None:
            margin = r["rerank_margin"] if "rerank_margin" in shown.columns else None
            head = f"[cos {r['score']:.3f}] " if margin is None else f"[rr {margin:5.2f} · cos {r['vector_score']:.3f}] "
        lines += ["", f"{n:2d}. {head}{r['_title']}", f"    {r['categories']}  ·  {r['update_date']}  ·  {r['_url']}"]
        if r["authors"]:
            lines.append("    " + textwrap.shorten(r["_names"], 100, placeholder=" et al."))
        if full:
            lines.append(textwrap.fill(r["_text"], 88, initial_indent="    ", subsequent_indent="    "))
    return lines or ["No matches."]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodestar")
    p.add_argument("--index", default="index")
    p.add_argument("--dim", type=int, default=64)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("snapshot", nargs="?")
    build.add_argument("--embed-only", action="store_true")
    up = sub.add_parser("update")
    up.add_argument("--max-pages", type=int, default=MAX_PAGES)
    for name in ("search", "similar"):
        q = sub.add_parser(name)
        q.add_argument("text", nargs="?" if name == "search" else None, default="")
        q.add_argument("-k", type=int, default=DEFAULT_K)
        q.add_argument("--rerank", action="store_true")
        q.add_argument("--scores", action="store_true")
        q.add_argument("--full", action="store_true")
        if name == "search":
            q.add_argument("--category", action="append", choices=SCOPE)
            q.add_argument("--since", type=valid_date)
            q.add_argument("--author")
            q.add_argument("--json", action="store_true")
    sub.add_parser("status")
    sub.add_parser("compact")
    sub.add_parser("cite").add_argument("id")
    web = sub.add_parser("serve")
    web.add_argument("--host", default="127.0.0.1")
    web.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "search" and not (args.text.strip() or args.category or args.since or args.author):
        raise SystemExit("give a query, an author, a category or a date")
    spark = spark or SparkSession.builder.appName("lodestar").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    embedder = HashingEmbedder(args.dim)
    store = Store(spark, args.index, embedder.model, embedder.dim)
    if args.command == "build":
        store.check_model()
        if not args.embed_only:
            if not args.snapshot:
                raise SystemExit("build needs a snapshot")
            store.upsert(scan_snapshot(spark, args.snapshot))
        print(f"{store.embed_pending(embedder)} embedded")
        refresh_all(store)
    elif args.command == "update":
        print(json.dumps(update(store, embedder, max_pages=args.max_pages)))
        refresh_all(store)
    elif args.command in ("search", "similar"):
        store.check_model()
        reranker = OverlapReranker() if args.rerank else None
        if args.command == "search" and not args.text.strip():
            found = S.Found(newest(store, args.k, args.category, args.since, args.author)[0], "date")
        elif args.command == "search":
            found = S.search_view(SEARCH_VIEW.read(store), store.lookup, args.text, S.cached_embedding(embed_query(embedder)), args.k, args.category, args.since, args.author, reranker)
        else:
            found = S.similar_in_view(SEARCH_VIEW.read(store), store.lookup, args.text, args.k, reranker)
        if found.warning:
            print(found.warning)
        print("\n".join(found.hits.toJSON().collect() if getattr(args, "json", False) else formatted(found.hits, args.full, args.scores)))
    elif args.command == "status":
        found = store.status()
        print(json.dumps({k: v for k, v in found.items() if k != "categories"}))
        for category, n in found["categories"].items():
            print(f"{category}: {n}")
    elif args.command == "compact":
        print(f"{store.compact()} slots reclaimed")
    elif args.command == "serve":
        view = ResidentView(store, embedder, OverlapReranker())
        with server(view, args.host, args.port) as running:
            print(f"http://{args.host}:{running.server_port}/api/stats", flush=True)
            try:
                running.serve_forever()
            except KeyboardInterrupt:
                print("waiting for requests under way")
        view.close()
    else:
        entry = store.lookup([args.id]).select(biblatex()).first()
        if entry is None:
            raise SystemExit(f"{args.id} is not in the index")
        print(entry[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
