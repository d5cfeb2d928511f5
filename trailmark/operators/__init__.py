"""DataFrame operators: idempotent writes, runs of rows, search, review signals, scheduling."""
