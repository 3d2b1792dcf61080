import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from termloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        **{
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tagged(spark):
    """Builds an annotated table from 'word/TAG' or 'word/TAG/NER' sentences."""

    def build(*documents):
        rows = []
        for i, sentences in enumerate(documents):
            parsed = [
                [
                    (word, word.lower(), tag[0], tag[1] if len(tag) > 1 else None)
                    for word, *tag in (token.rsplit("/", token.count("/")) for token in s.split())
                ]
                for s in sentences
            ]
            rows.append((i, parsed))
        from termloom.functions.text import SENTENCES_TYPE

        return spark.createDataFrame(rows, f"row_id int, sentences {SENTENCES_TYPE}")

    return build


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables and gives their folder."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(
                str(tmp_path / f"{name}.parquet")
            )
        return str(tmp_path)

    return write


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
