import pytest

from tabulyse.llm.staging import staged

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, source) rows, with columns whose names may clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).selectExpr("*", "'x' as key", "1 as fingerprint", "2 as u", "3 as size", "'y' as _text", "4 as component_id_")

    return make


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that these modules write, as (label, plan) in a list that grows."""

    def watch(*modules):
        seen = []

        def recorded(df, label):
            seen.append((label, plan(df)))
            return staged(df, label)

        for module in modules:
            monkeypatch.setattr(module, "staged", recorded)
        return seen

    return watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
