"""Column expressions."""

from tallymark.functions.amounts import exact_sum, hundredths, large_amount, quoted, units

__all__ = ["exact_sum", "hundredths", "large_amount", "quoted", "units"]
