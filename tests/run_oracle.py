"""Check every query against its oracle: python tests/run_oracle.py [sf_dir] [key ...]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

import __spark_entry__ as contract
from compare import check, connect

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    oracle = contract.oracle_sql()
    names = sys.argv[2:] or list(contract.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", os.environ.get("ZONE", "UTC")).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                result = check(spark, con, sf_dir, name)
            else:
                result = None if contract.queries()[name](spark, sf_dir).count() else "no rows"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.2f}s {result or ''}", flush=True)
    print(f"{len(names)} queries, {bad} failures")
