"""Compares a registered query with its SQL on a second engine."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    return sorted(repr([_plain(r[n]) for n in names]) for r in frame.collect())


def sql_rows(sql, sf=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr([_plain(r[i]) for i in order]) for r in found.fetchall())


def _plain(value):
    return repr(value) if isinstance(value, float) else value
