"""Job entry point: `python -m tripflow --config job.json`, or this file under spark-submit."""

import argparse
import dataclasses
import logging

from tripflow.config import PipelineConfig
from tripflow.plans import ingest_file, run_stream, sink_for
from tripflow.session import build_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tripflow", description="Ingest trip CSV files.")
    parser.add_argument("--config", required=True, help="JSON settings")
    parser.add_argument("--available-now", action="store_true", help="take what is waiting, then end")
    parser.add_argument("--input", action="append", metavar="URI", help="ingest these objects as one batch instead")
    parser.add_argument("--batch-id", type=int, help="id to store the --input batch under")
    parser.add_argument("--replace", action="store_true", help="overwrite that batch if it is already stored")
    args = parser.parse_args(argv)
    if args.input and args.batch_id is None:
        parser.error("--input needs --batch-id")

    logging.basicConfig(level=logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    config = PipelineConfig.load(args.config)
    if args.available_now:
        config = dataclasses.replace(config, trigger=None)
    spark = build_session(spark_conf=config.spark_conf)
    if args.input:
        ingest_file(spark, args.input, sink_for(config), args.batch_id, replace=args.replace)
    else:
        run_stream(spark, config)


if __name__ == "__main__":
    main()
