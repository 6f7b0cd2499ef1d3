"""Start a job from any working directory, locally or with spark-submit:

    python run_job.py preprocess --config config.json
    spark-submit run_job.py model --panel master.parquet --model ets --out results/
    spark-submit run_job.py report --panel master.parquet --predictions results/predictions --out report/ ...

The session is the one spark-submit configures (``local[*]`` if no master is
given); the package is shipped to the executors.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from meterframe.plans import modeling, preprocess, report  # noqa: E402
from meterframe.session import job_session  # noqa: E402

JOBS = {"preprocess": preprocess.main, "model": modeling.main, "report": report.main}


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in JOBS:
        print(f"usage: run_job.py {{{','.join(JOBS)}}} ...", file=sys.stderr)
        return 2
    spark = job_session(f"meterframe-{argv[0]}")
    try:
        JOBS[argv[0]](argv[1:])
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
