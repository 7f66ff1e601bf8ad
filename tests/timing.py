"""Time the Spark side of registered queries: ``python -m tests.timing sf name ...``."""

import sys
import time

import __spark_entry__ as entry
from lorelink.session import local_session

if __name__ == "__main__":
    spark, queries = local_session(), entry.queries()
    for name in sys.argv[2:] or queries:
        start = time.time()
        rows = queries[name](spark, f"/root/testdata/sf{sys.argv[1]}").toArrow().num_rows
        print(f"{name:28s} rows={rows} {time.time() - start:.1f}s", flush=True)
