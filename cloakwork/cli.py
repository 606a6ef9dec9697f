"""Command lines: ``redact`` makes a bundle of one document, ``evaluate`` a report of annotations.

A command that fails ends with code 1 and tells the class of its error alone, since a message may
quote the document.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Mapping, Sequence
from contextlib import ContextDecorator
from dataclasses import dataclass, field
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from cloakwork.operators import evaluate
from cloakwork.operators.resolve import detect, entity_rows
from cloakwork.plans import bundle
from cloakwork.sources import annotations
from cloakwork.sources.store import MappingKey


def session() -> SparkSession:
    return SparkSession.builder.appName("cloakwork").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@dataclass
class Context:
    """What a command reads besides its options."""

    environment: Mapping[str, str]
    make_session: Callable[[], SparkSession]


def redact(options: argparse.Namespace, context: Context) -> None:
    settings = annotations.settings_from(options.config)
    key = MappingKey.from_environment(context.environment) if options.key_file is None else MappingKey.from_file(options.key_file)
    bundle.accept(options.input, options.output_dir)
    bundle.create_bundle(context.make_session(), options.input, options.output_dir, key, settings, options.seed)


def report(spark: SparkSession, path: str) -> str:
    """Markdown for an annotation file; detection runs once, without deny lists."""
    rows = annotations.annotated(spark, path)
    cases, gold = annotations.cases(rows), annotations.gold(rows)
    pred = entity_rows(detect(cases), ["dataset", "case_id"])
    sides = evaluate.Sides.of(gold, pred)
    names = [r["dataset"] for r in cases.select("dataset").distinct().orderBy("dataset").collect()]
    metrics = evaluate.entity_metrics(*sides).collect()
    return evaluate.render_report(metrics, evaluate.token_accuracy(cases, *sides).collect(), names)


def write_report(options: argparse.Namespace, context: Context) -> None:
    options.output.write_text(report(context.make_session(), str(options.annotations)), encoding="utf-8")


@dataclass(frozen=True)
class Command:
    about: str
    run: Callable[[argparse.Namespace, Context], None]
    needed: dict[str, type]
    optional: dict[str, type] = field(default_factory=dict)


COMMANDS = {
    "redact": Command(
        f"redact a document into a new directory, all or nothing; the mapping key is in --key-file or {bundle.KEY_VARIABLE}",
        redact,
        {"--input": Path, "--output-dir": Path, "--config": Path, "--seed": int},
        {"--key-file": str},
    ),
    "evaluate": Command("write exact-span metrics of annotated cases", write_report, {"--annotations": Path, "--output": Path}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cloakwork", epilog="A failure ends with a non-zero code and publishes nothing.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        own = commands.add_parser(name, help=command.about, description=command.about)
        for option, kind in (command.needed | command.optional).items():
            own.add_argument(option, type=kind, required=option in command.needed)
    return top


class Discreet(ContextDecorator):
    """Ends any error inside; ``code`` is what the process should end with."""

    def __init__(self, name: str, told: TextIO):
        self.name, self.told, self.code = name, told, 0

    def __enter__(self) -> Discreet:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if kind is None or not issubclass(kind, Exception):
            return False
        self.code = 1
        self.told.write(f"cloakwork: {self.name} failed ({kind.__name__})\n")
        return True


def main(argv: Sequence[str] | None = None, environment: Mapping[str, str] = os.environ, told: TextIO | None = None, make_session=session) -> int:
    options = parser().parse_args(argv)
    with Discreet(options.command, told or sys.stderr) as outcome:
        COMMANDS[options.command].run(options, Context(environment, make_session))
    return outcome.code


if __name__ == "__main__":
    sys.exit(main())
