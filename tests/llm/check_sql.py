"""Command line: python tests/llm/check_sql.py SF_DIR [name ...] runs the package's queries against their SQL."""

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from oracle import canon, connect  # noqa: E402

from colonnade.llm.queries import QUERIES, SQL  # noqa: E402
from colonnade.session import build_session  # noqa: E402


def main(sf_dir, names):
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names or QUERIES:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        rows = df.collect()
        head = f"{name}: {len(rows)} rows, {time.time() - t0:.1f} s"
        if name in SQL:
            t0 = time.time()
            cur = con.execute(SQL[name])
            want = canon([d[0] for d in cur.description], cur.fetchall())
            got = canon(df.columns, rows)
            head += f", SQL {time.time() - t0:.1f} s, " + ("same" if got == want else f"DIFFERENT {got[0]} {want[0]} {[r for r in got[1] if r not in set(want[1])][:3]} {[r for r in want[1] if r not in set(got[1])][:3]}")
            bad += got != want
        print(head, df.dtypes, rows[:1], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
