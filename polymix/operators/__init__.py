"""Statistics, vector kernels and model steps as joins and aggregates."""
