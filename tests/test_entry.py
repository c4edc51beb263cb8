import importlib
import json
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry module imports and the rest stays where these are gone."""
    for name in ("__spark_entry__.py", "origo"):
        (tmp_path / name).symlink_to(TOP / name) if name.endswith(".py") else subprocess.run(["cp", "-r", str(TOP / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "origo" / "llm")], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((TOP / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    names = json.loads(said.stdout.strip().splitlines()[-1])
    assert "asof_rfm_panel" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


@pytest.mark.parametrize("name", ["asof_rfm_panel", "subscription_panel", "person_period_panel", "score_by_origin"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables")
    catalog = importlib.import_module("origo.plans.catalog")
    con = duckdb.connect()
    for table in ("orders", "lineitem", "events", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, d).toPandas()[list(want.columns)]
    rows = lambda f: sorted(map(repr, f.astype(object).map(lambda v: float(v) if not isinstance(v, str) and v is not None else v).values.tolist()))
    assert rows(got) == rows(want)


def test_read_through(spark, tmp_path):
    from origo import sources

    with pytest.raises(FileNotFoundError):
        sources.load_retail(spark, str(tmp_path / "none.csv"), str(tmp_path / "cache"))
    (tmp_path / "raw.csv").write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n1,A,x,2,2011-01-01T00:00:00,1.5,7.0,UK\n")
    assert sources.load_retail(spark, str(tmp_path / "raw.csv"), str(tmp_path / "cache")).first()["revenue"] == 3.0
    sources.write_result({"roc_auc": 0.9, "brier": 0.1}, str(tmp_path / "r.json"))
    assert sources.headline_numbers(sources.read_result(str(tmp_path / "r.json")), {"roc_auc": 0.8, "brier": 0.2})["brier_worse"] == 1.0
