"""Forecasting by key (F1-F12): one series per pandas group inside Spark
tasks, or one pooled model fitted with distributed aggregates."""
