"""Multi-operator jobs and read-side queries."""
