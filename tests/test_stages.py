"""Stages reused by fingerprint."""

import json
import subprocess
import sys

import pytest

from hubrisk.session import scratch_path
from hubrisk.sources import stages as SG


def _input(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "v long").coalesce(1).write.mode(mode).parquet(path)


@pytest.fixture
def made(spark):
    """A stage that counts how often it is built."""
    root, src, built = scratch_path(spark, "t-stages"), scratch_path(spark, "t-stage-input"), []
    _input(spark, src, [(1,), (2,)])

    def get(params="p", name="s", inputs=(src,)):
        def build():
            built.append(params)
            return spark.read.parquet(src)
        return sorted(r.v for r in SG.reused(spark, root, name, list(inputs), params, build).collect())
    return root, src, built, get


def test_reused_until_something_changes(spark, made, monkeypatch):
    root, src, built, get = made
    assert get() == get() == [1, 2] and len(built) == 1
    assert get("q") == [1, 2] and get(name="t") == [1, 2] and len(built) == 3  # other parameters, another stage
    _input(spark, src, [(3,)])
    assert get() == [1, 2, 3] and len(built) == 4  # changed input
    monkeypatch.setattr(SG, "code_version", lambda: "newer")
    assert get() == [1, 2, 3] and get() == [1, 2, 3] and len(built) == 5


def test_half_written_stages_are_ignored(spark, made):
    root, src, built, get = made

    class Lost(Exception):
        pass

    def broken():
        _input(spark, f"{root}/s/whatever/rows-x", [(9,)])
        raise Lost
    with pytest.raises(Lost):
        SG.reused(spark, root, "s", [src], "p", broken)
    assert get() == [1, 2] and len(built) == 1
    fs, path = SG.file_system(spark, f"{root}/s")
    done = [s.getPath().toString() for s in fs.listStatus(path) if not s.getPath().getName().startswith("whatever")]
    mark = SG.file_system(spark, f"{done[0]}/manifest/_SUCCESS")
    assert SG.manifest(spark, done[0])["inputs"]["files"] > 0
    mark[0].delete(mark[1], False)  # as if the manifest had not been finished
    assert get() == [1, 2] and get() == [1, 2] and len(built) == 2


def test_a_second_process_reuses_the_stage(spark, made, tmp_path):
    root, src, built, get = made
    assert get() == [1, 2]
    code = f"""
import json
from hubrisk.session import build_session
from hubrisk.sources import stages as SG
spark = build_session(master="local[2]", driver_memory="1g")
def build():
    raise SystemExit("built again")
print(json.dumps(sorted(r.v for r in SG.reused(spark, {root!r}, "s", [{src!r}], "p", build).collect())))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=200)
    assert json.loads(out.stdout.strip().splitlines()[-1]) == [1, 2]
    assert SG.code_version() == SG.code_version() and len(SG.code_version()) == 64
