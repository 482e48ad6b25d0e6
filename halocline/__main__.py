"""python -m halocline -i points.csv -e 0.5 -m 5 -c 16 -f 2: cluster a CSV file of points."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from halocline.plans.clustering import IMPLEMENTATIONS, SAMPLERS, Configuration, run


def parse(args: list[str] | None = None) -> Configuration:
    p = argparse.ArgumentParser(prog="halocline", description=__doc__)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-e", "--epsilon", type=float, required=True)
    p.add_argument("-m", "--min-pts", type=int, required=True)
    p.add_argument("-c", "--cells", type=int, required=True)
    p.add_argument("-f", "--factor", type=float, required=True)
    p.add_argument("-b", "--batch", type=int, default=10_000, help="accepted for scripts; Spark sizes its own partitions")
    p.add_argument("-w", "--workers", type=int, default=1)
    p.add_argument("-s", "--sink", choices=("ignored", "memory", "csv"), default="ignored")
    p.add_argument("-M", "--metrics", default=None)
    p.add_argument("-S", "--sampler", choices=SAMPLERS, default="kmeans")
    p.add_argument("-D", "--implementation", choices=IMPLEMENTATIONS, default="grid")
    p.add_argument("--no-header", dest="header", action="store_false")
    p.add_argument("--seed", type=int, default=-1)
    return Configuration(**vars(p.parse_args(args)))


def main() -> None:
    out = run(SparkSession.builder.appName("halocline").getOrCreate(), parse())
    if out is not None:
        print("\n".join(map(str, out)))


if __name__ == "__main__":
    main()
