"""DataFrame operators: reports, scheduling, change sets, audit, data quality."""
