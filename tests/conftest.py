import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    out = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


def text(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def rows(df, columns=None):
    """Rows as sorted tuples of text, columns by name."""
    columns = columns or sorted(df.columns)
    return sorted(tuple(text(v) for v in r) for r in df.select(*columns).collect())


def sql_rows(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in found.fetchall())
