from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from gradeflow.session import get_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "gradeflow-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def prompts(spark):
    rows = [("1", "f", "a", "d"), ("2", "f", "b", "e"), ("3", "f", "c", "f")]
    return spark.createDataFrame(
        rows, "prompt_id string, prompt_title string, prompt_question string, prompt_text string"
    )


@pytest.fixture
def responses(spark):
    rows = [("1", "1", "a", 0.0, 0.0), ("2", "2", "b", 0.5, 0.5), ("3", "3", "c", 1.0, 1.0)]
    return spark.createDataFrame(
        rows, "student_id string, prompt_id string, text string, content double, wording double"
    )


@pytest.fixture(scope="session")
def skewed(spark):
    """Scored rows in folds of which one holds over a third of all rows."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        fold = "hot" if i % 5 < 2 else f"p{i % 7}"
        x = rng.normal(size=3) + (2.0 if fold == "hot" else 0.0)
        noise = rng.normal(scale=0.1, size=2)
        content = 1.0 + x @ [0.5, -1.0, 0.25] + noise[0]
        wording = -2.0 + x @ [0.0, 0.3, 2.0] + noise[1]
        rows.append((f"s{i}", fold, [float(v) for v in x], float(content), float(wording)))
    return spark.createDataFrame(
        rows, "student_id string, prompt_id string, features array<double>, content double, wording double"
    ).cache()
