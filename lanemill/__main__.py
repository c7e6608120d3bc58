"""Run a job: ``python -m lanemill lanes|frames|batches|view|all ...``.

Parameters come from ``--config`` (a file of ``name: value`` lines) and from ``--set name=value``,
which goes before it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import config, schemas
from .plans import jobs, pipelines
from .sources import writers
from .sources.layout import Layout


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lanemill", description=__doc__)
    jobs_ = parser.add_subparsers(dest="job", required=True)
    lanes = jobs_.add_parser("lanes", help="roadgraph JSON to lane snapshots")
    lanes.add_argument("samples")
    frames = jobs_.add_parser("frames", help="scans and predictions to the target frame")
    for name in ("poses", "pcd", "predictions", "transforms"):
        frames.add_argument(name)
    batches = jobs_.add_parser("batches", help="converted predictions to sliding batches")
    batches.add_argument("frames")
    view = jobs_.add_parser("view", help="a lane snapshot as styled markers")
    view.add_argument("lanes")
    view.add_argument("--seq", type=int, default=0)
    for p in (lanes, frames, batches, view):
        p.add_argument("out")
    whole = jobs_.add_parser("all", help="all jobs of one index, by the layout of folders below a root")
    whole.add_argument("root")
    whole.add_argument("transforms")
    show = jobs_.add_parser("show", help="what a viewer shows of one index, as tables")
    show.add_argument("root")
    show.add_argument("out")
    for p in (whole, show):
        p.add_argument("--index", type=int, help="of the files; start_index if left out")
    for p in (lanes, frames, batches, view, whole, show):
        p.add_argument("--config")
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    args = parser.parse_args(argv)
    s = config.read_settings(args.config) if args.config else config.Settings()
    s = config.settings(config.parse("\n".join(x.replace("=", ": ", 1) for x in args.set)), s)
    spark = SparkSession.builder.appName(f"lanemill {args.job}").getOrCreate()
    transforms = spark.read.schema(schemas.TRANSFORMS).json(args.transforms) if "transforms" in args else None
    if args.job == "lanes":
        jobs.lanes_job(spark, args.samples, args.out, s.lane)
    elif args.job == "frames":
        jobs.frames_job(spark, args.poses, args.pcd, args.predictions, transforms, args.out, s.frame)
    elif args.job == "batches":
        jobs.batches_job(spark, spark.read.parquet(args.frames), args.out, s.batch)
    elif args.job == "view":
        writers.write_table(pipelines.viewer(spark.read.parquet(args.lanes), args.seq), args.out)
    else:
        layout = Layout(args.root, s.batch.start_index if args.index is None else args.index, s)
        if args.job == "all":
            found = jobs.run_all(spark, layout, transforms)
            for name in ("lane_counters", "frame_counters"):
                writers.write_table(found[name], f"{layout.out}/{name}")
        else:
            for name, table in jobs.view(spark, layout).items():
                writers.write_table(table, f"{args.out}/{name}")


if __name__ == "__main__":
    main()
