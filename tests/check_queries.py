"""Command line check: python tests/check_queries.py SF_DIR [name-part ...]"""

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from colonnade.plans.registry import load_all  # noqa: E402
from colonnade.session import build_session  # noqa: E402


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in load_all().items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        try:
            ok, msg = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, "".join(traceback.format_exception_only(e))[:1500]
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
