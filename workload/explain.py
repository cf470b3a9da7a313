"""Print the formatted physical plan of registered queries.

    python -m workload.explain name ... [--sf dir]
"""

from __future__ import annotations

import argparse

from vinculum.session import build_session
from workload.catalog import QUERIES


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="+", choices=sorted(QUERIES))
    parser.add_argument("--sf", default="/root/testdata/sf0.1")
    args = parser.parse_args()
    spark = build_session("explain", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.names:
        print(f"== {name}")
        QUERIES[name](spark, args.sf).explain("formatted")


if __name__ == "__main__":
    main()
