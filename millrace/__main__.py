"""python -m millrace [--stream | --once] JOB INPUT... OUTPUT: runs a registered job on folders of JSON text.

The texts are envelopes, or changes.  By default the folders are read once as they are;
``--stream`` reads files as they arrive, ``--once`` those that are new since the last run.
"""

from __future__ import annotations

import sys

from . import config
from .operators.parse import EnvelopeParser
from .plans import runner
from .plans.jobs import REGISTRY
from .sinks.sinks import DlqSink
from .sources.cdc import COLUMNS


def usage() -> int:
    print("usage: python -m millrace [--stream | --once] JOB INPUT... OUTPUT\njobs: " + ", ".join(sorted(REGISTRY)), file=sys.stderr)
    return 1


def main(args: list[str]) -> int:
    mode = args[0] if args and args[0] in ("--stream", "--once") else None
    args = args[1:] if mode else args
    if len(args) < 3 or args[0] not in REGISTRY:
        return usage()
    name, *inputs, out = args
    spark = config.session(name)
    if mode:
        runner.start(spark, name, inputs, out, once=mode == "--once").wait()
        return 0
    dead = DlqSink(f"{out}/dlq")
    frames = []
    for path in inputs:
        if name == "MongoToKafka":
            frames.append(spark.read.schema(COLUMNS).json(path))
        else:
            parsed = EnvelopeParser().apply(spark.read.text(path))
            dead.write(parsed.dlq)
            frames.append(parsed.main)
    r = REGISTRY[name].build(*frames)
    r.main.write.mode("overwrite").json(f"{out}/main")
    for side, df in r.sides.items():
        df.write.mode("overwrite").json(f"{out}/{side}")
    dead.write(r.dlq)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
