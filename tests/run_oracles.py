"""Run queries against their SQL: python -m tests.run_oracles SF_DIR [names...]"""

import sys
import time

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.oracle_check import connect, differences


def main(sf_dir, names):
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = f(spark, sf_dir)
            if name in oracles:
                problems, n = differences(df, con, oracles[name])
            else:
                problems, n = ["no oracle"], df.count()
        except Exception as e:  # report and go on
            problems, n = [f"{type(e).__name__}: {str(e)[:900]}"], -1
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} rows={n} {time.time() - start:.1f}s", *problems, sep="\n    " if problems else " ", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
