"""``python -m pagemill NAME TABLES [--out FOLDER]`` runs a named query; without a name it lists them."""

from __future__ import annotations

import argparse

from pagemill.plans.queries import QUERIES as RULES
from pagemill.plans.scans import QUERIES as SCANS
from pagemill.plans.stateful import QUERIES as STATEFUL
from pagemill.session import session


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagemill")
    parser.add_argument("name", nargs="?")
    parser.add_argument("tables", nargs="?")
    parser.add_argument("--out", help="folder to write Parquet to, instead of showing rows")
    got = parser.parse_args(args)
    queries = {**RULES, **SCANS, **STATEFUL}
    if not got.name:
        print("\n".join(sorted(queries)))
        return
    if got.name not in queries or not got.tables:
        parser.error(f"a query of {len(queries)} and a folder of tables are asked for")
    df = queries[got.name](session(), got.tables)
    df.write.mode("overwrite").parquet(got.out) if got.out else df.show(truncate=False)


if __name__ == "__main__":
    main()
