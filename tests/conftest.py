from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from asklens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Twelve examples over six databases; the last but one has no schema.
SAMPLE = [
    ("Which ferries were built before 1990?", "SELECT label FROM Ferry WHERE built < 1990", "harbour"),
    ("How deep is the deepest berth?", "SELECT MAX(depth) FROM Berth", "harbour"),
    ("Crates per variety, best first", "SELECT t.variety, SUM(h.crates) FROM Tree AS t JOIN Harvest AS h ON t.tree_no = h.tree_no "
     "GROUP BY t.variety ORDER BY SUM(h.crates) DESC", "orchard"),
    ("When does the Petrel sail for more than 12?",
     "SELECT s.departs FROM Sailing s JOIN Ferry f ON s.ferry_id = f.id WHERE f.label = 'Petrel' AND s.fare > 12", "harbour"),
    ("Which wards had visits over 45 minutes?", "SELECT DISTINCT ward FROM Visit WHERE minutes > 45", "clinic"),
    ("How many boxes does the archive hold?", "SELECT COUNT(*) FROM Box", "archive"),
    ("How many trees stand in the orchard?", "SELECT COUNT(*) FROM Tree", "orchard"),
    ("Visits cheaper than 80", "SELECT visit_no FROM Visit WHERE cost < 80", "clinic"),
    ("Hosts without a long show", "SELECT host FROM Show WHERE host NOT IN (SELECT host FROM Show WHERE length > 90)", "radio"),
    ("Mean height of each row of trees", "SELECT row_no, AVG(height) FROM Tree GROUP BY row_no", "orchard"),
    ("Which stations report rain?", "SELECT station FROM Reading WHERE rain > 0", "weather"),
    ("Piers where each ferry lands", "SELECT F.label, B.pier FROM Ferry AS F JOIN Landing AS L ON F.id = L.ferry_id "
     "JOIN Berth AS B ON L.berth_id = B.id", "harbour"),
]


@pytest.fixture(scope="session")
def sample(spark):
    rows = [(i, *r) for i, r in enumerate(SAMPLE)]
    return spark.createDataFrame(rows, "example_id bigint, question string, sql string, db_id string").cache()


@pytest.fixture(scope="session")
def catalog(spark):
    tables = {
        "harbour": {"Ferry": ["id", "label", "built"], "Berth": ["id", "pier", "depth"],
                    "Sailing": ["no", "ferry_id", "departs", "fare"], "Landing": ["ferry_id", "berth_id"]},
        "orchard": {"Tree": ["tree_no", "variety", "height", "row_no"], "Harvest": ["tree_no", "day", "crates"]},
        "clinic": {"Visit": ["visit_no", "ward", "minutes", "cost"]},
        "archive": {"Box": ["box_no", "shelf"]},
        "radio": {"Show": ["code", "host", "length"]},
    }
    rows = [(db, ti, t, ci, c, "TEXT", None) for db, ts in tables.items()
            for ti, (t, cs) in enumerate(ts.items()) for ci, c in enumerate(cs)]
    from asklens.schemas import CATALOG

    return spark.createDataFrame(rows, CATALOG)
