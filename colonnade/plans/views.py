"""Derived inputs: the grid, series, point and segment shapes of the operators.

Each text is plain SQL that Spark and the checking database read alike.  Frames
are suppliers, series are users and runs are customers, so the number of groups
grows with the data while a single grid (64 x 64) or series (31 days) does not.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    # sparse 64 x 64 value grids, one per frame; an absent cell is invalid
    "fx_pixels": """
SELECT l_suppkey AS frame_id, CAST(l_partkey % 64 AS INT) AS r, CAST(l_orderkey % 64 AS INT) AS c,
       MIN(CAST(l_quantity AS BIGINT)) AS d
FROM {lineitem} GROUP BY 1, 2, 3""",
    # expected and predicted class per cell (1..7); classes 4..7 carry instance ids
    "fx_masks": """
SELECT frame_id, r, c, gt, pred,
       CASE WHEN gt >= 4 THEN (gt + 20) * 1000 + CAST(FLOOR(r / 16.0) AS INT) ELSE gt END AS gt_id,
       CASE WHEN pred >= 4 THEN (pred + 20) * 1000 + CAST(FLOOR(r / 16.0) AS INT) ELSE pred END AS pred_id
FROM (SELECT l_suppkey AS frame_id, CAST(l_orderkey % 64 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c,
             MAX(l_linenumber) AS gt, MIN(l_linenumber) AS pred
      FROM {lineitem} GROUP BY 1, 2, 3) m""",
    # one ordered series per user, at most 31 positions with gaps
    "fx_series": """
SELECT user_id AS series_id, CAST(dayofmonth(ts) - 1 AS INT) AS pos,
       CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS v
FROM {events} GROUP BY 1, 2""",
    # class counts per series position; five classes 0..4
    "fx_class_cost": """
SELECT user_id AS series_id, CAST(dayofmonth(ts) - 1 AS INT) AS pos,
       CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                       WHEN 'signup' THEN 3 ELSE 4 END AS class_id,
       COUNT(*) AS n
FROM {events} GROUP BY 1, 2, 3""",
    # points to cluster: a class, integer coordinates and a size
    "fx_points": """
SELECT event_id AS pt_id,
       CASE event_type WHEN 'click' THEN 11 WHEN 'error' THEN 12 WHEN 'purchase' THEN 13
                       WHEN 'signup' THEN 14 ELSE 15 END AS class_id,
       CAST(ROUND(value * 100) AS BIGINT) AS x, user_id * 100 AS y,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS size
FROM {events}""",
    # repeated runs: one run per customer, one measured frame per order
    "fx_runs": """
SELECT o_custkey AS run_id, o_orderkey AS frame, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS ms
FROM {orders}""",
    # strips of eight cells, rows counted from the bottom; md is the highest value of a strip row
    "fx_strips": """
SELECT frame_id, CAST(FLOOR(c / 8.0) AS INT) AS col_id, 63 - r AS v,
       MAX(d) AS md, CAST(SUM(c) AS BIGINT) AS sc
FROM {fx_pixels} GROUP BY 1, 2, 3""",
    # segments on strips of width 8: one starts at row 0 and a new one at every high cell
    "fx_segments": """
SELECT frame_id, col_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY frame_id, col_id ORDER BY v_b DESC) - 1 AS INT) AS seg_idx,
       CAST(md % 3 AS INT) AS type, v_b, v_t, md AS disparity,
       CAST(CASE md % 3 WHEN 0 THEN md % 2 WHEN 2 THEN 10
            ELSE CASE WHEN (md * 7 + v_b) % 16 < 8 THEN (md * 7 + v_b) % 16 + 2
                      ELSE (md * 7 + v_b) % 16 + 3 END END AS INT) AS class_id,
       md * 100 - v_b AS cost, 8 * col_id + sc % 8 AS mean_x,
       CAST(FLOOR((v_b + v_t) / 2.0) AS BIGINT) AS mean_y,
       CAST(CASE WHEN sc % 4 = 0 THEN -1 ELSE sc % 5 END AS INT) AS inst
FROM (SELECT frame_id, col_id, CASE WHEN k = 1 THEN 0 ELSE v END AS v_b, md, sc,
             CAST(COALESCE(LEAD(v) OVER (PARTITION BY frame_id, col_id ORDER BY v) - 1, 63) AS INT) AS v_t
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY frame_id, col_id ORDER BY v) AS k FROM {fx_strips} g) h
      WHERE md >= 35 OR k = 1) b""",
    # file listing: a stem and a kind read off each address
    "fx_files": """
SELECT page_id, url AS path,
       concat(lang, '_', lpad(CAST(CAST(FLOOR(num / 20.0) AS INT) AS STRING), 6, '0')) AS stem,
       concat(lang, '_', lpad(CAST(num AS STRING), 6, '0'), '_',
              lpad(CAST(page_id AS STRING), 9, '0'), '_image.png') AS file_name,
       lang, num,
       CASE WHEN url LIKE '%?%' THEN 'image' WHEN url LIKE '%#%' THEN 'disparity'
            WHEN url LIKE '%.html' OR url LIKE '%/' THEN 'camera' ELSE 'semantic' END AS kind
FROM (SELECT page_id, url, regexp_extract(url, '/([a-z]+)/([0-9]+)', 1) AS lang,
             CAST(regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) AS INT) AS num FROM {pages}) p""",
}


def view_closure(names: tuple[str, ...]) -> list[str]:
    """The named views with those they read from, in an order that defines before use."""
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in re.findall(r"\{(fx_\w+)\}", VIEWS[name]):
            visit(dep)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out
