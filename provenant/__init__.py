"""Provenant: versioned evidence analytics as plain DataFrame programs.

Every operator is a pure function of DataFrames; no module holds a session.
"""
