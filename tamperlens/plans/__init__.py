"""Plan shapes shared by the operators: staging, skew-safe joins, block windows."""
