"""Readers (S1-S4, S9-S11) and writers."""
