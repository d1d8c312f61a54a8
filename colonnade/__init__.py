"""colonnade: grid, series and cluster analytics written as PySpark jobs.

Large pixel-like grids are cut into strips ("columns"), every strip is cut into
an optimal sequence of segments, segments are clustered into objects, and the
objects are projected, rasterised and scored.  Each step is a function from
DataFrame to DataFrame that takes column names, so it runs on any table that has
a key, a position and a value.
"""

__version__ = "0.1.0"
