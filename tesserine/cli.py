"""python -m tesserine.cli build ROOT --store DIR | query TEXT --store DIR: an index of a folder of source files."""

from __future__ import annotations

import argparse

from tesserine.plans.manager import IndexManager
from tesserine.session import build_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tesserine")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("root")
    build.add_argument("--version")
    build.add_argument("--full", action="store_true")
    query = commands.add_parser("query")
    query.add_argument("text")
    query.add_argument("--top-k", type=int, default=8)
    for name in ("module", "language", "symbol"):
        query.add_argument(f"--{name}")
    for command in (build, query):
        command.add_argument("--store", default="snapshots")
    given = parser.parse_args(arguments)
    manager = IndexManager(build_session(), given.store)
    if given.command == "build":
        changed, nodes = manager.build(given.root, given.version, given.full)
        print(f"files {changed}, chunks {nodes}, version {manager.store.active_version()}")
        return
    for row in manager.ask(given.text, given.module, given.language, given.symbol, top_k=given.top_k).toLocalIterator():
        print(f"{row['rank']}. {row['score']:.4f} {row['file_path']}:{row['start_line']}-{row['end_line']} {row['symbol']}")


if __name__ == "__main__":
    main()
