from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.session import build_session  # noqa: E402

T0 = datetime(2023, 8, 15, 12, 0, 0)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def gauge_of(spark):
    """Gauge rows from ``{gpu: cells}``; None = idle, ``...`` = no cell."""

    def build(columns: dict[str, list], step: int = 15):
        rows = []
        for gpu, cells in columns.items():
            node, idx = gpu.rsplit("#", 1)
            for i, cell in enumerate(cells):
                if cell is not ...:
                    rows.append((at(i * step), node, int(idx), gpu, None if cell is None else float(cell)))
        return spark.createDataFrame(rows, "ts timestamp, node string, gpu_idx int, gpu string, code double")

    return build


@pytest.fixture
def onsets_of(spark):
    """Onset rows from ``(seconds, gpu[, code])``."""

    def build(rows):
        data = []
        for r in rows:
            sec, gpu, code = (*r, 43)[:3]
            node, idx = gpu.rsplit("#", 1)
            data.append((at(sec), gpu, node, int(idx), code))
        return spark.createDataFrame(data, "ts timestamp, gpu string, node string, gpu_idx int, code int")

    return build
