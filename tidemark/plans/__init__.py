"""Registered queries: each module binds operators to the study views and states the equivalent ANSI SQL."""
