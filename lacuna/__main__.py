"""Run an experiment on a CSV file with a header.

    spark-submit --py-files lacuna.zip lacuna/__main__.py iris.csv --preset iris --method knn --percent 10
    python -m lacuna iris.csv --features a,b,c --target t --compare --out reports/iris

Without ``--out`` only the summary is shown; with it, detail and summary (or
the comparison) are written there as parquet.
"""

import argparse

from pyspark.sql import SparkSession

from lacuna.plans import ERASING, HEADACHE, IRIS, METHODS, PERCENTS, compare_grid, run_experiment
from lacuna.sources import load_csv, with_row_id, write_summary

PRESETS = {"iris": IRIS, "headache": HEADACHE}
SETTINGS = {"num_trees": int, "max_depth": int, "max_bins": int, "impurity": str, "feature_subset": str, "max_iter": int, "block_size": int, "seed": int}
HAVE = {
    "tree": {"max_depth", "max_bins", "impurity", "seed"},
    "forest": {"num_trees", "feature_subset", "max_depth", "max_bins", "impurity", "seed"},
    "perceptron": {"max_iter", "block_size", "seed"},
}


def arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lacuna", description=__doc__.splitlines()[0])
    parser.add_argument("csv")
    parser.add_argument("--preset", choices=PRESETS)
    parser.add_argument("--features", help="comma-separated columns")
    parser.add_argument("--target")
    parser.add_argument("--key", help="column that identifies a row; generated if left out")
    parser.add_argument("--method", choices=METHODS, default="knn")
    parser.add_argument("--percent", type=float, default=10)
    parser.add_argument("-k", type=int, default=10)
    parser.add_argument("--mode", choices=["known", "compat"], default="known")
    parser.add_argument("--erase", choices=ERASING, default="hash")
    parser.add_argument("--erase-seed", type=int, default=42)
    parser.add_argument("--max-classes", type=int, default=1000)
    for name, kind in SETTINGS.items():
        parser.add_argument("--" + name.replace("_", "-"), type=kind, help="of learners that have it")
    parser.add_argument("--compare", action="store_true", help="all methods at 10 to 50 percent")
    parser.add_argument("--k-is-percent", action="store_true", help="with --compare: the percent is k")
    parser.add_argument("--out")
    chosen = parser.parse_args(argv)
    if not chosen.preset and not (chosen.features and chosen.target):
        parser.error("give --preset, or --features and --target")
    return chosen


def main(argv=None) -> None:
    chosen = arguments(argv)
    preset = PRESETS.get(chosen.preset)
    features = list(preset.features) if preset else chosen.features.split(",")
    target = preset.target if preset else chosen.target
    codes = preset.codes if preset else None
    spark = SparkSession.builder.appName("lacuna").getOrCreate()
    needed = [*features, target] + ([chosen.key] if chosen.key and chosen.key not in features else [])
    rows = with_row_id(load_csv(spark, chosen.csv).select(*needed), chosen.key)
    given = {name: getattr(chosen, name) for name in SETTINGS if getattr(chosen, name) is not None}
    options = {m: {"mode": chosen.mode} | {n: v for n, v in given.items() if n in have} for m, have in HAVE.items()}
    erasing = {"erase": chosen.erase, "erase_seed": chosen.erase_seed, "max_classes": chosen.max_classes}
    if chosen.compare:
        grid = compare_grid(
            rows, features, target, percents=PERCENTS, k="percent" if chosen.k_is_percent else chosen.k, codes=codes,
            options=options, **erasing,
        )
        if chosen.out:
            write_summary(grid, chosen.out)
        else:
            grid.show(len(METHODS) * len(PERCENTS), truncate=False)
        return
    report = run_experiment(
        rows, features, target, chosen.method, chosen.percent, k=chosen.k, codes=codes,
        **erasing, **options.get(chosen.method, {}),
    )
    if chosen.out:
        report = report.save(chosen.out)
    report.summary.show(truncate=False)


if __name__ == "__main__":
    main()
