from __future__ import annotations

import os

import pytest


@pytest.fixture(scope="session")
def tables():
    """The smallest driver tables."""
    path = os.environ.get("TABLES_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no driver tables here")
    return path
