import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"{folder}/checkpoints")
        .config("spark.local.dir", f"{folder}/local")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents with hard cases: nulls, empty, blank and long texts, copies, an extra column."""
    from pyspark.sql import functions as F

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    longest = base.orderBy(F.desc("n_chars")).first()["text"]
    rows = [(100_001, None, "en", None, None), (100_002, "", None, "src0", 0), (100_003, " \n\t ", "fr", "src1", 3), (100_004, longest * 20, "en", "src0", None), (100_005, longest, None, None, None), (100_006, "12 34 !!", None, "src2", 8), (100_007, longest, "en", "src0", None)]
    extra = spark.createDataFrame(rows, base.schema)
    return base.unionByName(extra).withColumn("size", F.lit(1)).withColumn("token", F.lit("x")).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
