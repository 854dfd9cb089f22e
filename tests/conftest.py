import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session
    s = local_session(4, shuffle_partitions=8, app="tessera-tests")
    yield s


@pytest.fixture
def survey_rows():
    """The reference validator fixture: 3 valid survey rows (17 columns) with ids."""
    return [
        dict(id=1, Gender="Male", Age=25.0, Height=1.75, Weight=70.0, family_history="yes", FAVC="yes", FCVC=2.0,
             NCP=3.0, CAEC="Sometimes", SMOKE="no", CH2O=2.0, SCC="no", FAF=1.0, TUE=1.0, CALC="no",
             MTRANS="Public_Transportation", Obesity="Normal_Weight"),
        dict(id=2, Gender="Female", Age=32.0, Height=1.62, Weight=58.0, family_history="no", FAVC="no", FCVC=1.0,
             NCP=2.0, CAEC="no", SMOKE="no", CH2O=1.0, SCC="yes", FAF=0.0, TUE=0.5, CALC="Sometimes",
             MTRANS="Walking", Obesity="Insufficient_Weight"),
        dict(id=3, Gender="Male", Age=45.0, Height=1.80, Weight=90.0, family_history="yes", FAVC="yes", FCVC=3.0,
             NCP=4.0, CAEC="Frequently", SMOKE="no", CH2O=3.0, SCC="no", FAF=2.0, TUE=2.0, CALC="Sometimes",
             MTRANS="Automobile", Obesity="Obesity_Type_I"),
    ]


def make_survey(spark, rows):
    from tessera.sources.survey import survey_schema
    schema = survey_schema()
    value = lambda f, v: str(v) if f.name == "id" and v is not None else v
    return spark.createDataFrame([tuple(value(f, r.get(f.name)) for f in schema.fields) for r in rows], schema)
