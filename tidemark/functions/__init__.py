"""functions of the log, snapshot and metrics engine."""
