"""Python code in tasks works where the package cannot be imported."""

import os
import subprocess
import sys

SCRIPT = """
import io, sys, tarfile
sys.path.insert(0, {repo!r})
from wardline.session import local_session
from wardline.functions.jsonqa import json_report
from wardline.sources.readers import read_archive_lines
with tarfile.open("a.tar", "w") as tar:
    info = tarfile.TarInfo("x.db"); info.size = 4
    tar.addfile(info, io.BytesIO(b"one\\n"))
spark = local_session(cores="1", partitions=1)
docs = spark.createDataFrame([('{{"a":1,"a":2}}',)], "t string")
print("RESULT", docs.select(json_report("t").alias("r")).first().r.duplicate_keys, read_archive_lines(spark, "a.tar").first().line)
"""


def test_functions_travel_with_the_job(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200
    )
    assert "RESULT ['a'] one" in done.stdout, done.stderr[-2000:]
