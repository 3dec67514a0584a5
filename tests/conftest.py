import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


class Repo:
    """A throw-away repository, one method call a commit."""

    def __init__(self, path: Path):
        self.path, self.day = path, 1
        path.mkdir(parents=True)
        self.git("init", "-q", "-b", "main")

    def git(self, *args: str) -> None:
        env = os.environ | {"GIT_AUTHOR_DATE": f"2024-01-{self.day:02d}T10:00:00Z", "GIT_COMMITTER_DATE": f"2024-01-{self.day:02d}T10:00:00Z", "GIT_CONFIG_GLOBAL": "/dev/null"}
        subprocess.run(["git", "-C", str(self.path), *args], check=True, capture_output=True, env=env)

    def commit(self, author: str = "Ann", **files: str | None) -> None:
        for name, text in files.items():
            at = self.path / name.replace("__", "/").replace("_DOT_", ".")
            if text is None:
                at.unlink()
            else:
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(text)
        self.git("add", "-A")
        self.git("-c", f"user.name={author}", "-c", f"user.email={author.lower()}@x.org", "commit", "-qm", f"change {self.day}")
        self.day += 1


@pytest.fixture
def repo(tmp_path):
    return Repo(tmp_path / "sample")
