"""Run registered queries next to their SQL oracles and compare rows.

    python tests/oracle_check.py [--sf 0.01] [--rows-only] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(pdf: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return "[" + ",".join(cell(x) for x in v) + "]"
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, float) or "float" in type(v).__name__:
            f = float(v)
            return str(int(f)) if f == int(f) and abs(f) < 1e17 else repr(f)
        return str(v)

    out = pdf[sorted(pdf.columns)].astype(object).map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def types_differ(spark_types, description) -> list[str]:
    want = {d[0]: str(d[1]) for d in description}
    return [f"{c}: {t} / {want[c]}" for c, t in spark_types if c in want and DUCK.get(t) != want[c]]


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canon(got), canon(want)
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        i = bad.idxmax()
        return f"{int(bad.sum())} rows differ, first\n   got  {a.loc[i].to_dict()}\n   want {b.loc[i].to_dict()}"
    return None


def main(argv):
    sf, only, prefixes = "0.01", False, []
    while argv:
        a = argv.pop(0)
        if a == "--sf":
            sf = argv.pop(0)
        elif a == "--rows-only":
            only = True
        else:
            prefixes.append(a)
    import __spark_entry__ as entry
    from waitline import get_session

    spark = get_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8",
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = df.toPandas()
        except Exception as e:  # noqa: BLE001 - report and go on
            print(f"ERR  {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.2f}s")
            continue
        try:
            res = con.execute(oracles[name])
            described = res.description
            want = res.df()
        except Exception as e:  # noqa: BLE001
            print(f"SQL  {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        t2 = time.time()
        why = compare(got, want)
        drift = types_differ(df.dtypes, described)
        note = f" type drift {drift}" if drift else ""
        print(f"{'FAIL' if why else 'ok  '} {name}: {len(got)} rows spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s{note}" + (f"\n   {why}" if why else ""))
        if why:
            bad.append(name)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
