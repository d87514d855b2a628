"""``python tests/llm/compare.py sf0.01 op1_quality ...``: queries against their SQL."""

from __future__ import annotations

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), os.path.dirname(HERE)]

from oracle import compare, connect  # noqa: E402

from framemetry.llm import ORACLES, QUERIES  # noqa: E402
from framemetry.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8"})
    for name in sys.argv[2:] or QUERIES:
        t = time.time()
        if name in ORACLES:
            print(name, *compare(spark, connect(sf), QUERIES[name], ORACLES[name], sf), f"{time.time() - t:.1f}s", flush=True)
        else:
            df = QUERIES[name](spark, sf)
            df.write.format("noop").mode("overwrite").save()
            print(name, df.columns, f"{time.time() - t:.1f}s", flush=True)
