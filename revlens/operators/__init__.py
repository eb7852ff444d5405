"""Revenue-analytics operators: DataFrame in, lazy DataFrame out."""

from revlens.operators.breakdown import (  # noqa: F401
    annual_summary,
    arpu_by_product,
    arpu_by_region,
    arpu_by_segment,
    arpu_overall,
    business_overview,
    discount_bucket,
    discount_impact,
    revenue_breakdown,
    revenue_by_industry,
    revenue_by_product,
    revenue_by_region,
    revenue_by_segment,
    top_customers,
)
from revlens.operators.churn import (  # noqa: F401
    churn_status,
    churned_revenue_list,
    cohort_retention,
    monthly_churn,
    monthly_churn_brief,
    revenue_churn,
)
from revlens.operators.clean import clean, clean_preview, clean_row_count, register_clean_view  # noqa: F401
from revlens.operators.mrr import (  # noqa: F401
    arpu_monthly,
    best_worst_months,
    customer_month,
    executive_summary,
    monthly_totals,
    mrr_by_product,
    mrr_growth,
    mrr_growth_brief,
    mrr_monthly,
    mrr_running,
    quarterly_summary,
)
from revlens.operators.quality import (  # noqa: F401
    date_coverage,
    distinct_products,
    distinct_regions,
    distinct_segments,
    distinct_values,
    duplicate_order_count,
    duplicate_orders,
    load_profile,
    null_profile,
    nonpositive_sales,
    quality_report,
    raw_preview,
    raw_row_count,
    sales_distribution,
    sales_distribution_approx,
    suspicious_dates,
)
from revlens.operators.rank import ntile_of, percentiles_cont, rank_ntile  # noqa: F401
from revlens.operators.value import (  # noqa: F401
    cross_sell,
    customer_running_revenue,
    customer_tiers,
    customer_tiers_brief,
    customer_totals,
    revenue_movement,
)
