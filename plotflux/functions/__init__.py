"""Column functions: casts, dates, keys, bins, calibrations, units, and p-values."""
