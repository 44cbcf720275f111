from ledgerline.functions.dates import day
from ledgerline.functions.exact import exact_mean, exact_sum, hundredths

__all__ = ["day", "exact_mean", "exact_sum", "hundredths"]
