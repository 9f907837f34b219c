"""``python -m tidemill.sources TBL_DIR OUT_DIR SCHEMAS``: import pipe-delimited tables as Parquet.

SCHEMAS is a JSON file: of each table's name the Spark schema, as ``df.schema.jsonValue()`` gives it.
"""

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .tables import import_tbl_dir


def main(argv: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="python -m tidemill.sources", description="Import pipe-delimited tables as Parquet; tables that are there already are passed over.")
    for name in ("tbl_dir", "out_dir", "schemas"):
        p.add_argument(name)
    a = p.parse_args(argv)
    with open(a.schemas, encoding="utf-8") as f:
        schemas = {name: T.StructType.fromJson(s) for name, s in json.load(f).items()}
    done = import_tbl_dir(SparkSession.builder.getOrCreate(), a.tbl_dir, a.out_dir, schemas)
    print("imported:", ", ".join(done) or "nothing")
    return done


if __name__ == "__main__":
    main()
