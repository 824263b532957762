"""Command line: one run over a folder of inputs, resumed where its output already has rows of a note.

    python -m surestat extract  --root OUT --notes NOTES.csv --provider package.module:Factory [--dataset mimic ...]
    python -m surestat sample   --root OUT --notes NOTES.csv --provider ...
    python -m surestat combine  --root OUT --notes NOTES.csv --provider ... [--kg KG.csv --kge-matrix M.npy --kge-map MAP.csv]
    python -m surestat evaluate --root OUT [--provider ...]

Every field of config.Settings but its parity switches is an option; places that aren't given come from the environment.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from .config import Settings, paths_from_environment
from .plans import runs
from .sources import sinks, tables

_KINDS = {"str": str, "int": int, "int | None": int, "float": float}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="surestat", description="Confidence of generated diagnoses.")
    out.add_argument("run", choices=["extract", "sample", "combine", "evaluate"])
    for name in ("root", "notes", "provider", "kg", "kge-matrix", "kge-map"):
        out.add_argument(f"--{name}", required=name == "root")
    for f in fields(Settings):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            out.add_argument(flag, action="store_true")
        elif f.type in _KINDS:
            out.add_argument(flag, type=_KINDS[f.type], default=f.default)
    return out


def factory(name: str | None) -> Callable | None:
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Returns the run's output as it is stored now."""
    args = parser().parse_args(arguments)
    settings = Settings(**{f.name: getattr(args, f.name) for f in fields(Settings) if hasattr(args, f.name)})
    spark, provider, env = spark or SparkSession.builder.getOrCreate(), factory(args.provider), paths_from_environment()
    at = lambda kind: f"{args.root}/{settings.output(kind)}"
    stored = lambda kind: spark.read.parquet(at(kind))
    if args.run == "evaluate":
        metrics, log, overlap = runs.evaluated(stored("predictions"), stored("reference"), settings, provider)
        for kind, rows in (("metrics", metrics), ("alignment", log), ("overlap", overlap)):
            sinks.append_table(rows, args.root, settings, kind)
        return stored("metrics")
    kind = {"extract": "entities", "sample": "reference", "combine": "predictions"}[args.run]
    notes = tables.notes(spark, args.notes, settings)
    notes = tables.remaining(notes, tables.done(spark, at(kind), "parquet"))
    if args.run == "extract":
        sinks.append_table(runs.extract_entities(notes, settings, provider), args.root, settings, kind)
    elif args.run == "sample":
        sinks.append_table(runs.reference_scores(notes, settings, provider), args.root, settings, kind)
    else:
        edges = tables.kg_edges(spark, args.kg or env["KG_PATH"])
        vectors = tables.kge(spark, args.kge_matrix or env["KGE_EMB_PATH"], args.kge_map or env["KGE_MAP_PATH"])
        found = runs.combined_scores(notes, tables.with_entities(notes, stored("entities")), edges, vectors, settings, provider)
        runs.stored(found, args.root, settings)
    return stored(kind)


if __name__ == "__main__":
    main()
