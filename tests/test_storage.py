import subprocess
import sys

import pytest

from palimpsest.sources import external, storage


def tree(p):
    return {str(f.relative_to(p)): f.read_text() for f in p.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def test_empty_dir(spark, tmp_path):
    p = tmp_path / "a" / "b"
    storage.ensure_empty_dir(spark, str(p))
    assert p.is_dir()
    (p / "x").write_text("1")
    storage.ensure_empty_dir(spark, str(p))
    assert p.is_dir() and not list(p.iterdir())
    with pytest.raises(ValueError):
        storage.ensure_empty_dir(spark, "/")


def test_copytree_replaces_the_target(spark, tmp_path):
    s, d = tmp_path / "s", tmp_path / "d"
    (s / "sub").mkdir(parents=True)
    (s / "f").write_text("1")
    (s / "sub" / "g").write_text("2")
    for _ in range(2):
        storage.copytree(spark, str(s), str(d))
        assert tree(d) == {"f": "1", "sub/g": "2"}
        (d / "old").write_text("x")


def test_copytree_checks_first(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "keep").write_text("1")
    with pytest.raises(FileNotFoundError):
        storage.copytree(spark, str(tmp_path / "none"), str(d))
    for other in (d, d / "inside", tmp_path):
        (other).mkdir(exist_ok=True)
        with pytest.raises(ValueError):
            storage.copytree(spark, str(d), str(other))
    assert (d / "keep").read_text() == "1"


def test_build_step(tmp_path):
    script = "import sys; print('out'); print('err', file=sys.stderr); sys.exit(len(sys.argv) - 2)"
    assert sorted(external.run_build(tmp_path, ["-c", script, "x"], sys.executable).split()) == ["err", "out"]
    with pytest.raises(RuntimeError, match="err"):
        external.run_build(tmp_path, ["-c", script, "x", "y"], sys.executable)
    with pytest.raises(subprocess.TimeoutExpired):
        external.run_build(tmp_path, ["-c", "import time; time.sleep(9)"], sys.executable, timeout_sec=1)
    with pytest.raises(FileNotFoundError):
        external.run_build(tmp_path, [], "no-such-command")
    assert external.TIMEOUT_SEC == 1800
