import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from civigrade import build_session

    session = build_session(
        "local[8]", "civigrade-tests", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cells(spark):
    """Evaluate a column builder on a list of texts."""

    def run(build, values, schema="v string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
        return [row[0] for row in rows.orderBy("i").select(build(F.col("v")).alias("r")).collect()]

    return run


@pytest.fixture(scope="session")
def stage_rows(spark):
    """Staged rows of one sheet from dictionaries."""

    def run(raw_rows, normalized=None, import_id="imp", sheet="Dados"):
        normalized = normalized or [None] * len(raw_rows)
        rows = [(import_id, sheet, i, raw, norm) for i, (raw, norm) in enumerate(zip(raw_rows, normalized), start=1)]
        schema = "import_id string, sheet_name string, row_number long, raw_row map<string,string>, normalized_row map<string,string>"
        return spark.createDataFrame(rows, schema)

    return run
