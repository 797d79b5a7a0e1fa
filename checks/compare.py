"""Run registered queries next to their DuckDB statements: ``python -m checks.compare [sf] [name…]``."""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def arrow_rows(table) -> tuple[dict, list[tuple]]:
    names = sorted(table.column_names)
    types = {n: str(table.schema.field(n).type) for n in names}
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(tuple("∅" if v is None else repr(v) for v in row) for row in zip(*columns))
    return types, rows


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    got_types, got = arrow_rows(QUERIES[name](spark, sf_dir).toArrow())
    print(f"     {name:26s} spark {time.time() - started:6.2f}s", flush=True)
    if name not in ORACLE:
        return True, f"rows only: {len(got)}"
    want_types, want = arrow_rows(con.execute(ORACLE[name]).to_arrow_table())
    if sorted(got_types) != sorted(want_types):
        return False, f"columns {sorted(got_types)} vs {sorted(want_types)}"
    note = "" if got_types == want_types else " types: " + str({n: (got_types[n], want_types[n]) for n in got_types if got_types[n] != want_types[n] and {got_types[n], want_types[n]} != {"string", "large_string"}})
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return False, f"{len(got)} vs {len(want)} rows; {str(bad)[:1500]}{note}"
    return True, f"{len(got)} rows{note if note.strip() != 'types: {}' else ''}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checks-"))
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - started:6.2f}s {note}", flush=True)
    print(f"{len(names) - failed}/{len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(main())
