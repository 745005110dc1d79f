"""facet: a PySpark engine for record collections whose physical design adapts to the workload."""
