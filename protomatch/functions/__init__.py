from protomatch.functions.nulls import (
    keeps_nulls_last,
    na_text,
    number_text,
    strict,
    total_order,
    unique_count,
)

__all__ = ["keeps_nulls_last", "na_text", "number_text", "strict", "total_order", "unique_count"]
