"""Three small repositories to try things on: a straight line, several authors, and files that change all the time."""

from __future__ import annotations

import os
import shutil
import subprocess
from pathlib import Path

#: Of each repository its commits: author, message, and what the files hold from then on.
REPOSITORIES: dict[str, list[tuple[str, str, dict[str, str]]]] = {
    "simple-linear": [
        ("Ada", "Begin", {"app.py": "import store\n\n\ndef run():\n    return store.load()\n"}),
        ("Ada", "Add a store", {"store.py": "def load():\n    return {}\n"}),
        ("Ada", "Describe it", {"README.md": "# A line of commits\n"}),
        ("Ada", "Let it save", {"store.py": "def load():\n    return {}\n\n\ndef save(x):\n    return bool(x)\n"}),
        ("Ada", "Save in the end", {"app.py": "import store\n\n\ndef run():\n    x = store.load()\n    if x:\n        store.save(x)\n    return x\n"}),
    ],
    "multi-author": [
        ("Ada", "Begin", {"api.py": "import model\n\n\ndef get(k):\n    return model.find(k)\n"}),
        ("Ben", "A model", {"model.py": "def find(k):\n    return k\n"}),
        ("Cleo", "A view", {"view.py": "import api\n\n\ndef show(k):\n    return str(api.get(k))\n"}),
        ("Ben", "Find less", {"model.py": "def find(k):\n    return k or None\n"}),
        ("Ada", "Check keys", {"api.py": "import model\n\n\ndef get(k):\n    if k is None:\n        return None\n    return model.find(k)\n"}),
        ("Cleo", "Show nothing", {"view.py": "import api\n\n\ndef show(k):\n    return str(api.get(k) or '')\n"}),
        ("Ben", "Both at once", {"api.py": "import model\n\n\ndef get(k):\n    return model.find(k)\n", "model.py": "def find(k):\n    return None if k is None else k\n"}),
    ],
    "high-churn": [
        ("Ada", "Begin", {"hot.py": "LIMIT = 0\n", "warm.py": "import hot\n", "cold.py": "def rest():\n    return 0\n"}),
        *(("Ada", f"Tune {k}", {"hot.py": f"LIMIT = {k}\n" + "".join(f"STEP_{j} = {j * k}\n" for j in range(k)), **({"warm.py": f"import hot\n\nBASE = hot.LIMIT + {k}\n"} if k % 3 == 0 else {})}) for k in range(1, 14)),
    ],
}


def make(folder: str, clean: bool = False) -> list[str]:
    """The repositories under ``folder``, made where they are missing, or anew; their paths."""
    paths = []
    for name, commits in REPOSITORIES.items():
        path = Path(folder) / name
        paths.append(str(path))
        if clean and path.exists():
            shutil.rmtree(path)
        if (path / ".git").exists():
            continue
        path.mkdir(parents=True, exist_ok=True)
        _git(path, "init", "-q", "-b", "main")
        for day, (author, message, files) in enumerate(commits, 1):
            for file, text in files.items():
                (path / file).write_text(text)
            when = f"2024-03-{day:02d}T12:00:00Z"
            _git(path, "add", "-A")
            _git(path, "-c", f"user.name={author}", "-c", f"user.email={author.lower()}@example.org", "commit", "-qm", message, GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)
    return paths


def _git(path: Path, *args: str, **env: str) -> None:
    subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, env=os.environ | {"GIT_CONFIG_GLOBAL": os.devnull} | env)
