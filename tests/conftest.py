import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowsheaf import build_session, drop_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture
def write(tmp_path):
    """Write a small file from text or bytes, return its path."""

    def _write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode() if isinstance(content, str) else content)
        return str(path)

    return _write


def files_in_order(folder):
    """Text of the data files under a folder, taken by path."""
    found = []
    for root, _, names in os.walk(folder):
        found += [os.path.join(root, n) for n in names if not n.startswith((".", "_"))]
    return [open(f, newline="").read() for f in sorted(found)]
