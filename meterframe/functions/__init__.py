"""Column expressions: time (X1, X4-X6, X9), calendar (X2, X3), numeric (S3,
S4, T6) and forecast-error aggregates (A12, A13)."""
