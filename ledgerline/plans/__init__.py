from ledgerline.plans.pricing_summary import pricing_summary
from ledgerline.plans.regional_revenue import regional_revenue

__all__ = ["pricing_summary", "regional_revenue"]
