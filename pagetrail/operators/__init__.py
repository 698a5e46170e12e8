"""Operators: each module is a set of DataFrame -> DataFrame functions."""
