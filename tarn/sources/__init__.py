"""Sources, sinks and stored intermediate tables."""
