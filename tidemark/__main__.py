"""Loads from the command line: ``python -m tidemark --add-source evtx /evidence --session /data/case1``."""

from __future__ import annotations

import argparse
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark import packs
from tidemark.operators import rulefiles
from tidemark.plans.load import Progress, load
from tidemark.plans.session import Session, new_session_id
from tidemark.settings import Settings


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--add-source", nargs=2, action="append", default=[], metavar=("KIND", "PATH"), help="evtx, journald, aul, or the key of a built-in text format")
    p.add_argument("--session", help="folder of the session; a new one in the sessions folder if it is not given")
    p.add_argument("--ephemeral-session", action="store_true", help="a session in a temporary folder that is removed at the end")
    p.add_argument("--cleanup-dir", action="append", default=[], help="a temporary folder to remove at the end")
    p.add_argument("--settings", default="tidemark.toml")
    p.add_argument("--search", help="print the first rows that match")
    return p.parse_args(argv)


def cleanup(path: str | Path) -> bool:
    """Remove a folder below the system's temporary folder; any other is left alone."""
    whole, root = Path(path).resolve(), Path(tempfile.gettempdir()).resolve()
    if root not in whole.parents or not whole.is_dir():
        return False
    shutil.rmtree(whole)
    return True


def told(p: Progress) -> None:
    """Progress as a line of text."""
    doing = f", {p.running.step}: {p.running.tasks} of {p.running.all_tasks} tasks, {p.running.rows_written} rows written" if p.running else ""
    print(f"{p.files} of {p.total_files} files{doing}")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    settings = Settings.read(args.settings)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    temporary = list(args.cleanup_dir)
    if args.ephemeral_session:
        temporary.append(args.session or tempfile.mkdtemp(prefix="tidemark-session-"))
    path = temporary[-1] if args.ephemeral_session else args.session or f"{settings.sessions_dir}/{new_session_id()}"
    session, rules = Session(spark, path), packs.all_rules()
    if Path(settings.rules_dir).is_dir():
        rules += rulefiles.load(rulefiles.scan(settings.rules_dir))
    try:
        for kind, source in args.add_source:
            fmt = packs.text_formats().get(kind)
            done = load(session, "text" if fmt else kind, source, fmt, rules, zone=settings.default_source_timezone, group=settings.load_group, progress=told)
            print(f"{source}: {sum(done.inserted.values())} entries, {len(done.skipped)} files skipped")
        if args.search is not None:
            from tidemark.functions.timezones import Zone

            session.timeline().window(args.search, 0, 200, Zone.parse(settings.display_timezone)).show(truncate=False)
    finally:
        for folder in temporary:
            cleanup(folder)


if __name__ == "__main__":
    main()
