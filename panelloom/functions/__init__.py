from panelloom.functions.joins import asof_join, calendar  # noqa: F401
from panelloom.functions.columns import (  # noqa: F401
    Frames, by_ticker, ffill, nz, pct_change, per_instrument, present, safe_corr, skew_adjusted, sqrt0, tidy,
)
from panelloom.functions.order_stats import (  # noqa: F401
    average_rank, column_quantiles, counted_rank, ordered_counts, percent_rank, quantiles, rank_columns, row_positions, sliced,
)
from panelloom.functions.staging import stage, with_stats  # noqa: F401
