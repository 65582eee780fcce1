"""Distributed operators: joins, ranks, quantiles, sampling and profiling."""
