"""Every registered query runs; those with SQL give the rows of the SQL."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillspark import catalog

SLOW = {"reflective_answer"}


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5)
    if isinstance(v, (list, np.ndarray)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, np.integer) else v if isinstance(v, (int, bool)) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(v) for v in r)) for r in df[names].values.tolist())


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, data, sql, name):
    assert rows(catalog.queries()[name](spark, data).toPandas()) == rows(sql.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert df.columns and df.count() >= 0


def test_chunks_without_rxcui_stay_with_their_label(spark, tmp_path):
    columns = "row_id long, set_id string, rxcui string, layout_type string, verbatim_text string, drug_name_generic string, atc_code string, boxed_warning boolean"
    text = "Take one tablet of {0} in the morning with a full glass of water, and never more than two in a day. " * 2
    made = []
    for name, second in (("whole", "77"), ("part", None)):
        own = [(1, "A", "77", "dosing", text.format("x"), "x", "C10", False), (2, "a", second, "warning", text.format("y"), "x", "C10", False), (3, "b", None, "dosing", text.format("z"), "z", "C10", False)]
        spark.createDataFrame(own, columns).write.parquet(f"{tmp_path}/{name}/raw_chunks.parquet")
        made.append(sorted(map(str, catalog.queries()["ingest_labels"](spark, f"{tmp_path}/{name}").collect())))
    assert made[0] == made[1] and "tablet of y" in str(made[1]) and "tablet of z" not in str(made[1])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
