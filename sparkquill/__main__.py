"""python -m sparkquill index create|update -c CONFIG [-m MODEL]; ask -c CONFIG QUESTION; talk -c CONFIG (questions line by line); unreadable -c CONFIG."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from .plans.config import load
from .plans.session import SearchSession


def talk(session: SearchSession, label: str = "", read: Callable[[], str] = input, write: Callable[[str], None] = print) -> None:
    """Answers questions until there is no more input or an empty line; sources are printed with the best last, just above the next question."""
    while True:
        try:
            question = read().strip()
        except EOFError:
            return
        if not question:
            return
        try:
            got = session.answer(question, label)
        except ValueError as e:
            write(f"error: {e}")
            continue
        write(got["response"])
        for n, source in reversed(list(enumerate(got["sources"], 1))):
            write(f"[{n}] {source['score']:.4f} {source['link']}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkquill")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("action", choices=["create", "update"])
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--label", default="")
    chat = commands.add_parser("talk")
    chat.add_argument("--label", default="")
    for p in (index, ask, chat, commands.add_parser("unreadable")):
        p.add_argument("-c", "--config", required=True)
        p.add_argument("-m", "--model")
    args = parser.parse_args(argv)
    session = SearchSession(SparkSession.builder.appName("sparkquill").getOrCreate(), load(args.config, args.model))
    if args.command == "ask":
        print(json.dumps(session.answer(args.question, args.label), ensure_ascii=False, indent=2))
    elif args.command == "talk":
        talk(session, args.label)
    elif args.command == "unreadable":
        for row in session.unreadable().toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    elif args.action == "create":
        session.build()
    else:
        print(json.dumps(session.update()))


if __name__ == "__main__":
    main()
