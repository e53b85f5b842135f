"""``python -m hopquarry.cli run …``: an experiment from the command line."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from .plans.experiment import run_experiment
from .plans.methods import METHODS, Engine, Settings
from .sources.corpus import SOURCES, load


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="hopquarry")
    run = out.add_subparsers(dest="command", required=True).add_parser("run")
    run.add_argument("--dataset", choices=sorted(SOURCES), required=True)
    run.add_argument("--path", required=True)
    run.add_argument("--output", required=True)
    run.add_argument("--methods", nargs="+", choices=sorted(METHODS), default=["bm25", "graph"])
    run.add_argument("--tag")
    for f in fields(Settings):
        name = "--" + f.name.replace("_", "-")
        if f.default in (True, False):
            run.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        elif isinstance(f.default, tuple):
            run.add_argument(name, type=int, nargs="+", default=f.default)
        else:
            kind = type(f.default) if f.default is not None else float if f.name in ("tol", "seed_mix_alpha") else int
            run.add_argument(name, type=kind, default=f.default)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("hopquarry").getOrCreate()
    settings = Settings(**{f.name: tuple(v) if isinstance(v := getattr(args, f.name), list) else v for f in fields(Settings)})
    corpus = load(args.dataset, spark, args.path)
    run_experiment(Engine(corpus, settings), args.methods, args.output, {"dataset": args.dataset, "tag": args.tag}).show(truncate=False)


if __name__ == "__main__":
    main()
