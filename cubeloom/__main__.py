"""python -m cubeloom: run a query over a folder of tables, list the queries, or train a network of a configuration on a registered source."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from . import catalog, registry  # noqa: F401


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cubeloom", description=__doc__)
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list", help="names of the queries")
    one = todo.add_parser("query", help="run a query")
    one.add_argument("name")
    one.add_argument("tables", help="folder of the Parquet tables")
    one.add_argument("--out", help="folder for the result as Parquet; else its first rows are shown")
    run = todo.add_parser("train", help="train a network")
    run.add_argument("config", help="JSON file with sections network and training, or with keys of NetworkConfig alone")
    run.add_argument("source", help="name of a registered source")
    run.add_argument("tables")
    run.add_argument("--defaults", help="JSON file of the same form, for keys that the first lacks")
    run.add_argument("--module", action="append", default=[], help="a module to import first, which registers sources of the user's own")
    for name, kind in (("steps", int), ("mode", str), ("n_batches", int), ("save", str)):
        run.add_argument(f"--{name.removeprefix('n_')}", dest=name, type=kind, help=f"stands in for {name} of the section training")
    given = parser.parse_args(arguments)
    if given.todo == "list":
        print("\n".join(sorted(registry.queries())))
        return
    spark = SparkSession.builder.getOrCreate()
    if given.todo == "query":
        if given.name not in registry.queries():
            parser.error(f"no query {given.name}")
        df = registry.queries()[given.name](spark, given.tables)
        df.write.parquet(given.out) if given.out else df.show()
        return
    from .plans import settings, trainer
    from .plans.network import NetworkConfig
    from .sources import loaders

    for module in given.module:
        importlib.import_module(module)
    network, training = settings.read_settings(given.config, given.defaults)
    named = {k: v for k in ("steps", "mode", "n_batches", "save") if (v := getattr(given, k)) is not None}
    how = settings.TrainingSettings.parsed({**training, **named})
    t = trainer.Trainer.of(trainer.built(NetworkConfig.parsed(network)), loaders.source(given.source, spark, given.tables), how)
    t.run_by(how).show(how.steps)


if __name__ == "__main__":
    main()
