"""Command line: start one job and block, e.g. `python -m streamlat throughput-kafka ...`."""

from __future__ import annotations

import argparse
import inspect
from contextlib import nullcontext

from streamlat.session import build_session
from streamlat.streaming import jobs
from streamlat.streaming.progress import reported

JOBS = (jobs.record_latency_kafka, jobs.record_latency_port, jobs.parity_mean_kafka,
        jobs.parity_mean_port, jobs.throughput_kafka, jobs.measure_topic, jobs.measure_port)

# How the annotation of a job's argument is read from the command line.
TYPES = {"str": str, "str | None": str, "int": int, "int | None": int}


def make_parser() -> argparse.ArgumentParser:
    """One subcommand per job; its options are the job's keyword arguments."""
    parser = argparse.ArgumentParser(prog="streamlat", description=__doc__)
    parser.add_argument("--master", help="Spark master, where spark-submit does not set it")
    parser.add_argument("--parallelism", type=int, help="shuffle partitions")
    parser.add_argument("--progress", help="folder for a table of what the stream reports of each batch")
    commands = parser.add_subparsers(dest="job", required=True)
    for job in JOBS:
        command = commands.add_parser(job.__name__.replace("_", "-"), help=job.__doc__)
        command.set_defaults(run=job)
        for name, parameter in list(inspect.signature(job).parameters.items())[1:]:
            flag = "--" + name.replace("_", "-")
            if parameter.annotation == "bool":
                command.add_argument(flag, action=argparse.BooleanOptionalAction,
                                     default=parameter.default)
            else:
                required = parameter.default is inspect.Parameter.empty
                command.add_argument(flag, type=TYPES[parameter.annotation], required=required,
                                     default=None if required else parameter.default)
    return parser


def main(argv: list[str] | None = None) -> None:
    options = vars(make_parser().parse_args(argv))
    job, run = options.pop("job"), options.pop("run")
    spark = build_session(f"streamlat {job}", master=options.pop("master"),
                          parallelism=options.pop("parallelism"))
    progress = options.pop("progress")
    with reported(spark, progress) if progress else nullcontext():
        run(spark, **options).awaitTermination()


if __name__ == "__main__":
    main()
