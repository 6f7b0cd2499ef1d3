"""NTZ timestamps do not move with the process or JVM local time zone."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = r'''
import sys, datetime as dt
sys.path.insert(0, sys.argv[1])
from meterframe.session import local_session
from meterframe.operators import resample, panel
spark = local_session(2, 2)
df = spark.createDataFrame([("A", dt.datetime(2014, 3, 9, 1, 0), 1.0), ("A", dt.datetime(2014, 3, 9, 5, 30), 2.0)],
                           "client_id string, ts timestamp_ntz, y float")
lo, hi = resample.time_bounds(df, hourly=True)
hours = [r[0].hour for r in resample.hour_spine(df, lo, hi).orderBy("ts").collect()]
before, after = panel.split_at(df, dt.datetime(2014, 3, 9, 2, 30))
print(hours, before.count(), after.count())
spark.stop()
'''


def test_spine_and_cutoff_under_new_york_local_time():
    env = dict(os.environ, TZ="America/New_York")
    root = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", SCRIPT, root], env=env, capture_output=True,
                         text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1] == "[1, 2, 3, 4, 5] 1 1"
