"""Column expressions shared by the operators."""

from plantfuse.functions.measures import exact_sum, flag, pass_rate, rounded_sum, zero_if_null

__all__ = ["exact_sum", "flag", "pass_rate", "rounded_sum", "zero_if_null"]
