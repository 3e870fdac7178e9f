import duckdb

import suite
from lumatable.operators import stats

SF = "/root/testdata/sf0.001"


def test_masses_round_as_sql_does(spark, monkeypatch):
    """1.36085 lies just below the tie as a double; rounding its decimals gave 1.3609."""
    rows = spark.createDataFrame([(1, "blue", 234.8, 1.36085)], "image_id long, band string, median_hue double, mass double")
    monkeypatch.setattr(stats, "hue_band_medians", lambda pixels: rows)
    mass = suite.queries()["hue_band_medians"](spark, SF).first()["mass"]
    assert mass == duckdb.sql("SELECT round(1.36085::DOUBLE, 4)").fetchall()[0][0]
