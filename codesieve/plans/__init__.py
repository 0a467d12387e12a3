"""Compositions of operators: batch scan and change event."""
