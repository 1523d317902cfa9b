"""Reads in bounded pieces. The engine compares whole datasets, so there are no unbounded streams here."""
