"""python -m stratalake STORE COMMAND ...: the shared memory from a terminal, one JSON object a line."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession

from stratalake.operators.memory import DIRECTIONS, KINDS, SCOPES, Memory
from stratalake.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratalake", description=__doc__)
    top.add_argument("store")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **kinds):
        p = sub.add_parser(name)
        for a in arguments:
            p.add_argument(a, **kinds.get(a, {}))
        return p

    whole = {"type": int}
    command("create")
    command("check")
    command("sql", "text")
    command("history", "table")
    command("vacuum", "retain", retain=whole)
    command("person", "id", "name")
    command("source", "id", "person", "kind", "label", kind={"choices": KINDS})
    command("footage")
    command("add-footage", "rec", "source", "started", rec=whole, started=whole)
    ask = command("ask", "rec", "begin", "end", rec=whole, begin=whole, end=whole)
    ask.add_argument("--direction", choices=DIRECTIONS, default="forward")
    ask.add_argument("--scope", choices=SCOPES, default="all")
    ask.add_argument("--top", type=int, default=20)
    command("events", "query")
    command("serve")
    command("last-seen", "source", "begin", "end", begin=whole, end=whole)
    command("timeline")
    command("between", "owner", "begin", "end", begin=whole, end=whole)
    command("track", "owner", "name", "words", words={"type": int, "nargs": "+"})
    command("where", "owner", "name")
    command("confirm", "owner", "sighting")
    command("reject", "owner", "sighting")
    command("remember", "person", "subject", "note")
    command("recall", "person", "query")
    command("say", "owner", "question")
    return top


def run(spark: SparkSession, argv: list[str]):
    """The result of a command: a DataFrame, a value, or None."""
    a = parser().parse_args(argv)
    if a.command == "create":
        Store.create(spark, a.store)
        return {"created": a.store}
    store = Store.open(spark, a.store)
    m = Memory(store)
    done = {
        "check": store.describe, "footage": m.context, "timeline": m.timeline, "serve": lambda: {"answered": m.serve("terminal")},
        "sql": lambda: store.sql(a.text), "history": lambda: store.table(a.table).history(), "vacuum": lambda: {"removed": store.vacuum(a.retain, dry_run=False)},
        "person": lambda: m.add_person(a.id, a.name), "source": lambda: m.add_source(a.id, a.person, a.kind, a.label), "add-footage": lambda: m.add_footage(a.rec, a.source, a.started),
        "ask": lambda: {"query": m.enqueue(a.rec, a.begin, a.end, a.direction, a.scope, a.top)}, "events": lambda: m.events(a.query),
        "last-seen": lambda: m.last_seen(a.source, a.begin, a.end), "between": lambda: m.between(a.owner, a.begin, a.end),
        "track": lambda: {"runs": m.track(a.owner, a.name, a.words)}, "where": lambda: m.where_is(a.owner, a.name, int(time.time())),
        "confirm": lambda: m.confirm(a.owner, a.sighting), "reject": lambda: m.reject(a.owner, a.sighting),
        "remember": lambda: m.remember(a.person, a.subject, a.note), "recall": lambda: m.recall(a.person, a.query), "say": lambda: m.ask(a.owner, a.question, int(time.time())),
    }
    return done[a.command]()


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("stratalake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(spark, argv)
    for line in (out.toJSON().toLocalIterator() if isinstance(out, DataFrame) else [json.dumps(out)] if out is not None else []):
        print(line)


if __name__ == "__main__":
    main()
