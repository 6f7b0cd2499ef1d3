"""Jobs composed from the operators: preprocessing, backtests, reports and
the contract queries checked against DuckDB."""
