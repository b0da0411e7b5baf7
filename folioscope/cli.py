"""python -m folioscope.cli COMMAND: the engine's commands."""

from __future__ import annotations

import argparse
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from folioscope.engine import Engine
from folioscope.functions.config import env_text, incoming_root, library_root
from folioscope.operators import providers
from folioscope.streaming.extraction import format_duration


class Tee:
    """Writes to a stream and to a log, which is flushed each time so that it can be followed."""

    def __init__(self, stream, log):
        self.stream, self.log = stream, log

    def write(self, text: str) -> int:
        self.log.write(text)
        self.log.flush()
        return self.stream.write(text)

    def flush(self) -> None:
        self.stream.flush()

    def isatty(self) -> bool:
        return False


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioscope")
    top.add_argument("--library", default=library_root())
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, *options):
        sub = commands.add_parser(name)
        for flag, kind in options:
            sub.add_argument(flag, **kind)
        return sub

    book, flag, text = ("book_id", {}), {"action": "store_true"}, {"default": None}
    provider = [("--provider", {"default": env_text("FOLIOSCOPE_PROVIDER", "fake")}), ("--model", text), ("--url", text)]
    command("ingest", ("path", {}), ("--title", text), ("--author", text), ("--series", text), ("--series-position", {"type": int}), ("--content-type", {"choices": ["fiction", "nonfiction"], "default": "fiction"}), ("--no-auto-link", flag))
    command("extract", book, *provider, ("--restart", flag), ("--log", {"nargs": "?", "const": "", "default": None}))
    command("eval", book, ("--chapters", {"required": True}), ("--providers", {"default": "fake"}), ("--model", text), ("--models", text), ("--url", text))
    command("chat", book, ("--chapter", {"type": int, "required": True}), *provider, ("--question", text))
    command("list")
    command("show", book)
    command("remove", book, ("--yes", flag))
    command("aliases", book, ("--link", text), ("--auto", flag), ("--unlink", flag))
    command("doctor", ("--fix", flag), ("--merge-duplicates", flag), ("--split-cross-book", flag), ("--merge-name-variants", flag), ("--yes", flag))
    return top


def make_provider(name: str, model: str | None, url: str | None):
    options = {k: v for k, v in (("model", model), ("url", url)) if v is not None and name != "fake"}
    return providers.get_provider(name, **options)


def clean_up(path: str) -> None:
    """A staged file goes once its book is stored; others stay."""
    file, staging = Path(path).resolve(), Path(incoming_root()).resolve()
    if staging in file.parents and file.exists():
        file.unlink()


def run(args: argparse.Namespace, engine: Engine, say=print, ask=input) -> int:
    if args.command == "ingest":
        if Path(args.path).suffix.lower() != ".epub" or not Path(args.path).exists():
            say(f"can't ingest {args.path}: an existing .epub file is needed")
            return 1
        book_id, notes = engine.ingest_epub(args.path, title=args.title, author=args.author, series=args.series, position=args.series_position, content_type=args.content_type, auto_link=not args.no_auto_link)
        say(book_id, *notes, sep="\n")
        clean_up(args.path)
    elif args.command == "extract":

        def told(done: int, total: int, left: float | None) -> None:
            say(f"{done} of {total} chapters" + (f", about {format_duration(left)} left" if left else ""))

        if args.log is not None:
            log = args.log or str(Path(tempfile.gettempdir()) / f"extract_{args.book_id}.log")
            say(f"log: {log}")
            with open(log, "a", encoding="utf-8") as handle:
                tee = Tee(sys.stdout, handle)
                print(engine.extract(args.book_id, make_provider(args.provider, args.model, args.url), args.restart, progress=told), file=tee)
        else:
            say(engine.extract(args.book_id, make_provider(args.provider, args.model, args.url), args.restart, progress=told))
    elif args.command == "eval":
        models = args.models.split(",") if args.models else [args.model]
        made = {f"{n}:{m}" if m else n: make_provider(n, m, args.url) for n in args.providers.split(",") for m in models}
        say(*engine.compare(args.book_id, [int(k) for k in args.chapters.split(",")], made), sep="\n")
    elif args.command == "chat":
        provider = make_provider(args.provider, args.model, args.url)
        questions = iter([args.question]) if args.question else iter(lambda: ask("> "), "")
        for question in questions:
            answer, sources = engine.ask(args.book_id, args.chapter, question, provider)
            say(answer, *(f"  {line}" for line in sources), sep="\n")
    elif args.command == "list":
        for row in engine.catalog().orderBy("ord").collect():
            say(f"{row.book_id}\t{row.title}\t" + ("orphaned" if row.orphaned else f"{row.chapter_count} chapters\t{'not extracted' if row.fact_count is None else f'{row.fact_count} facts'}{' (partial)' if row.partial else ''}"))
    elif args.command == "show":
        for key, value in engine.show(args.book_id).asDict(recursive=True).items():
            say(f"{key}: {value}")
    elif args.command == "remove":
        if args.yes or ask(f"remove {args.book_id}? [y/N] ").strip().lower() == "y":
            engine.remove(args.book_id)
    elif args.command == "aliases":
        if args.link:
            engine.link(args.book_id, args.link.split(","))
        elif args.unlink:
            engine.unlink(args.book_id)
        elif args.auto:
            say(*engine.auto_link(args.book_id), sep="\n")
        else:
            from folioscope.operators import vocatives

            for row in vocatives.narrator_aliases(engine.chapters(args.book_id)).orderBy("place").collect():
                say(f"{row.name}: addressed {row.times_addressed} times ({row.verdict})")
    else:
        report = engine.doctor(args.fix)
        for kind, rows in report.items():
            say(f"{kind}: {len(rows)}", *(f"  {tuple(r)}" for r in rows), sep="\n")
        yes = (lambda ids: True) if args.yes else (lambda ids: ask(f"merge {', '.join(ids)}? [y/N] ").strip().lower() == "y")
        if args.merge_duplicates:
            engine.merge_found([[m.entity_id for m in r.members] for r in report["duplicate entities"]], yes)
        if args.merge_name_variants:
            engine.merge_found([list(r.members) for r in report["name variants"]], yes)
        if args.split_cross_book:
            for r in report["cross-book entities"]:
                engine.split(r.entity_id)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("folioscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(args, Engine(spark, args.library))
    except (ValueError, RuntimeError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
