"""Command line of a knowledge base: ``python -m quern.cli --root FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.service import KnowledgeBase, UpdateRefused
from quern.session import session
from quern.sources.snapshots import export_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("--root", required=True, help="folder of the knowledge base")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("index", help="register and index a folder")
    add.add_argument("folder")
    add.add_argument("--name")
    add.add_argument("--include", nargs="*", default=[])
    add.add_argument("--exclude", nargs="*", default=[])
    add.add_argument("--force", action="store_true")
    find = sub.add_parser("search", help="search the indexed chunks")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--threshold", type=float, default=0.5)
    find.add_argument("--repository")
    find.add_argument("--language")
    for name in ("status", "health", "update-all", "watched"):
        sub.add_parser(name)
    for name in ("remove", "update", "history", "reset-update", "check-completeness", "repair"):
        sub.add_parser(name).add_argument("name")
    job = sub.add_parser("job", help="how an update ended")
    job.add_argument("job_id")
    out = sub.add_parser("export", help="write the registry, the history or the chunks' list")
    out.add_argument("table", choices=("repositories", "history", "files"))
    out.add_argument("path")
    out.add_argument("--format", choices=("csv", "json", "markdown"), default="csv")
    return p


def _lines(df: DataFrame) -> None:
    for row in df.select(F.to_json(F.struct(*df.columns)).alias("line")).toLocalIterator():
        print(row.line)


def main(argv: list[str] | None = None, kb: KnowledgeBase | None = None) -> int:
    a = parser().parse_args(argv)
    kb = kb or KnowledgeBase(session("quern", a.master), a.root)
    try:
        if a.command == "index":
            name = a.name or a.folder.rstrip("/").rsplit("/", 1)[-1]
            if kb._find(name) is None:
                kb.register_local_folder(a.folder, name, a.include, a.exclude)
            print(json.dumps({"repository": name, "size": kb.index(name, a.force)}))
        elif a.command == "search":
            _lines(kb.search(a.query, a.limit, a.threshold, a.repository, a.language))
        elif a.command == "status":
            _lines(kb.list_repositories())
        elif a.command == "watched":
            _lines(kb.list_watched_folders())
        elif a.command == "health":
            print(json.dumps({"ok": True, "versions": {k: getattr(kb, k).version() for k in ("repositories", "manifest", "chunks")}}))
        elif a.command == "update":
            print(json.dumps({"job": kb.trigger_incremental_update(a.name)}))
        elif a.command == "update-all":
            for r in kb.list_repositories().select("repo_name").collect():  # the registry's names
                print(json.dumps({"repository": r[0], "job": kb.trigger_incremental_update(r[0])}))
        elif a.command == "job":
            print(json.dumps(kb.get_update_status(a.job_id), default=str))
        elif a.command == "history":
            _lines(kb.history(a.name))
        elif a.command == "reset-update":
            kb.reset_update(a.name)
        elif a.command == "check-completeness":
            print(json.dumps({"repository": a.name, "status": kb.check_completeness(a.name)}))
        elif a.command == "repair":
            print(json.dumps(kb.repair(a.name)))
        elif a.command == "remove":
            kb.remove(a.name)
        elif a.command == "export":
            df = {"repositories": kb.list_repositories, "history": kb.history_table.read, "files": kb.manifest.read}[a.table]()
            export_table(df.select(*[c for c in df.columns if not c.endswith(("extensions", "patterns"))]), a.path, a.format)
    except (UpdateRefused, LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
