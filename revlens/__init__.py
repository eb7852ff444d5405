"""revlens — revenue analytics (MRR, churn, cohorts, ARPU, tiers) as Spark DataFrame operators.

Every operator takes a DataFrame and returns a lazy DataFrame; nothing is
collected to the driver.  The typical flow is::

    from revlens import sources, operators as ops
    raw = sources.sales_table(spark, "/data/sf1")     # star schema -> saas_sales fact
    C = ops.clean(raw)                                 # cleaned view
    ops.mrr_growth(C).show()
"""

from revlens import functions, operators, sources  # noqa: F401
from revlens.operators import clean  # noqa: F401

__all__ = ["functions", "operators", "sources", "clean"]
