"""Command line: prepare one CSV dataset, fit the linear forecasters, print / store the metrics.

    python -m laglake --path data/ --date date --target OT --features HUFL HULL \\
        --granularity 60 --lag 128 --offset 32 --ahead 1 --normalization standard --out results/

With --sources, the models are fitted on other datasets (JSON files with the fields of ``DatasetSpec``) and scored on this one's test
windows; with --stored, the coefficients come from an earlier run's --out folder.
"""

from __future__ import annotations

import argparse
import json
import sys


def parse(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="laglake", description=__doc__.splitlines()[0])
    p.add_argument("--path", required=True, help="CSV file or folder (searched recursively)")
    p.add_argument("--date", required=True)
    p.add_argument("--target", nargs="+", required=True)
    p.add_argument("--features", nargs="*", default=[])
    p.add_argument("--segment", default=None)
    p.add_argument("--file-name-as-feature", default=None)
    p.add_argument("--delimiter", default=",")
    p.add_argument("--granularity", type=int, default=1440, help="minutes between grid steps")
    p.add_argument("--lag", type=int, default=5)
    p.add_argument("--ahead", type=int, default=1)
    p.add_argument("--offset", type=int, default=1)
    p.add_argument("--split", type=float, nargs=3, default=(0.7, 0.1, 0.2))
    p.add_argument("--normalization", choices=["minmax", "standard", "robust"], default=None)
    p.add_argument("--models", nargs="+", default=["linear", "nlinear", "dlinear"])
    p.add_argument("--lambdas", type=float, nargs="+", default=[0.0, 1.0, 10.0, 100.0])
    p.add_argument("--strategy", default="auto", choices=["auto", "range", "halo", "dense", "dense_halo"])
    p.add_argument("--time-format", default=None, help="strftime or Spark pattern of the date column")
    p.add_argument("--sources", nargs="+", default=[], help="zero-shot: JSON files of the datasets to fit on")
    p.add_argument("--stored", default=None, help="zero-shot: the --out folder of an earlier run, whose coefficients are used")
    p.add_argument("--out", default=None, help="folder for the metrics CSV and the coefficient store")
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    if a.sources and a.stored:
        p.error("--sources fits models, --stored loads them: give one of the two")
    return a


def source_spec(path: str):
    """A ``DatasetSpec`` from a JSON file with its fields."""
    from laglake.spec import DatasetSpec, StripTime
    with open(path, encoding="utf-8") as f:
        fields = json.load(f)
    if fields.get("strip_time"):
        fields["strip_time"] = StripTime(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields["strip_time"].items()})
    fields = {k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()}
    return DatasetSpec(**{"name": path, **fields})


def main(argv=None, spark=None):
    a = parse(argv)
    from laglake.plans.experiment import evaluate_stored, prepare_dataset, run_single, run_zero_shot
    from laglake.session import build_session
    from laglake.sources.stores import write_table
    from laglake.spec import DatasetSpec, WindowSpec
    spark = spark or build_session(a.master)
    spec = DatasetSpec(path=a.path, target=tuple(a.target), date=a.date, features=tuple(a.features), segment=a.segment,
                       delimiter=a.delimiter, granularity=a.granularity, file_name_as_feature=a.file_name_as_feature, time_format=a.time_format)
    ws = WindowSpec(lag=a.lag, ahead=a.ahead, offset=a.offset, minutes=a.granularity, ratios=tuple(a.split))
    ds = prepare_dataset(spark, spec, ws, normalization=a.normalization, strategy=a.strategy)
    kinds, lambdas = tuple(a.models), tuple(a.lambdas)
    if a.stored:
        out = evaluate_stored(spark, ds, f"{a.stored.rstrip('/')}/models", kinds=kinds)
    elif a.sources:
        sources = []
        for one in map(source_spec, a.sources):
            w = WindowSpec(lag=a.lag, ahead=a.ahead, offset=a.offset, minutes=one.granularity, ratios=tuple(a.split))
            sources.append(prepare_dataset(spark, one, w, normalization=a.normalization, strategy=a.strategy))
        out = run_zero_shot(spark, ds, sources, kinds=kinds, lambdas=lambdas)
    else:
        out = run_single(spark, ds, kinds=kinds, lambdas=lambdas, model_path=f"{a.out.rstrip('/')}/models" if a.out else None)
    if a.out:
        write_table(out, f"{a.out.rstrip('/')}/results", fmt="csv", single_file=True)
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
