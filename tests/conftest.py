import pytest

from headway.model import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def make(spark):
    """A frame from rows and a schema; `timestamp` columns may be given as text."""
    def build(rows, schema):
        texts = schema.replace("timestamp timestamp", "timestamp string").replace("ingest_ts timestamp", "ingest_ts string")
        df = spark.createDataFrame(rows, texts)
        for name in ("timestamp", "ingest_ts"):
            if name in df.columns:
                df = df.withColumn(name, df[name].cast("timestamp"))
        return df

    return build
