"""Output labels that must equal the reference's byte for byte.

Note the em dash (U+2014) and en dash (U+2013) characters, and the two spaces
after the emoji in LOW_VALUE and FLAT.
"""

# Discount buckets, in the order of the CASE branches (=0, <=0.10, <=0.20, <=0.40, else).
DISCOUNT_BUCKETS = ("0% — No Discount", "1–10%", "11–20%", "21–40%", "40%+")
DISCOUNT_BOUNDS = ("0.10", "0.20", "0.40")

# Month performance flags; the number is the n of best_worst_months (3 in the reference).
TOP_MONTH = "🟢 Top {n} Month"
BOTTOM_MONTH = "🔴 Bottom {n} Month"
AVERAGE_MONTH = "⚪ Average Month"

CHURNED = "Churned"
RETAINED = "Retained"

# Customer tiers by NTILE(4) bucket 1..4.
TIERS = ("🐋 Whale — Top 25%", "⭐ High Value — Top 50%", "📈 Mid Value", "⚠️  Low Value — Monitor")
TIERS_BRIEF = ("Whale — Top 25%", "High Value", "Mid Value", "Low Value — Monitor")

NEW_CUSTOMER = "New Customer"
EXPANSION = "📈 Expansion"
CONTRACTION = "📉 Contraction"
FLAT = "➡️  Flat"

SINGLE_PRODUCT = "Single Product"
CROSS_SELL_2 = "Cross-Sell (2 Products)"
MULTI_PRODUCT = ("Multi-Product Customer (", " products)")
