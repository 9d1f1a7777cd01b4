"""``python -m tierlake.cli load|convert|show``: corpora between files and stores, and documents as text."""

from __future__ import annotations

import argparse
import shutil
import sys
from typing import Any

from pyspark.sql import SparkSession

from tierlake.corpus import Corpus
from tierlake.meta import Catalog
from tierlake.sources import files

FORMATS = ["guess", "json", "jsonl", "yaml", "binary", "store"]


def _catalog(spark: SparkSession, path: str | None) -> Catalog | None:
    """The catalog of a header file; its documents, if it has any, aren't read."""
    return files.read_file(spark, path, header_only=True)[0] if path else None


def _read(spark: SparkSession, path: str, kind: str, meta: str | None, ignore_id_errors: bool = False) -> Corpus:
    kind = files.guess_format(path) if kind == "guess" else kind
    options: dict[str, Any] = {"kind": kind}
    if kind in ("json", "yaml"):
        options["ignore_id_errors"] = ignore_id_errors
    if kind in ("json", "yaml", "jsonl"):
        options["catalog"] = _catalog(spark, meta)
    return Corpus.read(spark, path, **options)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tierlake", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="a corpus file into a store")
    load.add_argument("file")
    load.add_argument("store")
    load.add_argument("--meta", help="descriptions of layers in a file of their own")
    load.add_argument("--jsonl", action="store_true", help="read one JSON object a line")
    convert = commands.add_parser("convert", help="a corpus from one format to another")
    convert.add_argument("input")
    convert.add_argument("output")
    convert.add_argument("--input-format", choices=FORMATS, default="guess")
    convert.add_argument("--output-format", choices=FORMATS, default="guess")
    convert.add_argument("--meta")
    convert.add_argument("--ignore-id-errors", action="store_true")
    show = commands.add_parser("show", help="one document or all as aligned text")
    show.add_argument("path")
    show.add_argument("--doc-id")
    show.add_argument("-f", "--format", choices=FORMATS, default="guess")
    show.add_argument("--meta")
    return top


def main(args: list[str] | None = None, out: Any = sys.stdout) -> None:
    asked = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "load":
        _read(spark, asked.file, "jsonl" if asked.jsonl else "guess", asked.meta).write(asked.store, "store")
    elif asked.command == "convert":
        corpus = _read(spark, asked.input, asked.input_format, asked.meta, asked.ignore_id_errors)
        corpus.write(asked.output, None if asked.output_format == "guess" else asked.output_format)
    else:
        corpus = _read(spark, asked.path, asked.format, asked.meta)
        out.write(corpus.show(asked.doc_id, shutil.get_terminal_size((80, 24)).columns) + "\n")


if __name__ == "__main__":
    main()
