import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1", "spark.driver.memory": "4g",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


def same_rows(spark, duck, query, sql, tmp_path):
    """Rows in the query but not the SQL, and the other way round."""
    out = str(tmp_path / "out")
    query(spark, DATA).write.parquet(out)
    duck.execute(f"create or replace temp view got as select * from read_parquet('{out}/*.parquet')")
    duck.execute(f"create or replace temp table wanted as {sql}")
    names = [sorted(r[0] for r in duck.execute(f"describe {t}").fetchall()) for t in ("got", "wanted")]
    assert names[0] == names[1]
    columns = ", ".join(f'"{n}"' for n in names[0])
    one = duck.execute(f"select {columns} from got except all select {columns} from wanted").fetchall()
    two = duck.execute(f"select {columns} from wanted except all select {columns} from got").fetchall()
    return one, two
