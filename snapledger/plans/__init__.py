"""Whole runs made of the operators: these write their results."""
