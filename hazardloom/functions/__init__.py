"""Column-level functions: no jobs, no joins, everything stays inside the JVM unless noted."""
