"""Fit and transform: each fit is a bounded number of aggregates, each transform a projection."""
