"""File formats as Python data sources: jls, pnm and pam.

register(spark) makes them available to spark.read.format(...) and
df.write.format(...).
"""

from tessella.sources.formats import register  # noqa: F401
