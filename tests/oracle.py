import glob
import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].to_dict("records"):
        row = []
        for v in r.values():
            if isinstance(v, (list, np.ndarray)):
                row.append(str(list(v)))
            elif v is None or v != v:
                row.append("null")
            else:
                row.append(f"{float(v):.6f}" if isinstance(v, (float, np.floating)) else str(int(v)) if isinstance(v, (bool, np.bool_)) else str(v))
        out.append(tuple(row))
    return sorted(out)


def by_sql(sql, sf=SF):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c.sql(sql).df()
