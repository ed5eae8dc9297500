"""Scalar functions: each takes and returns columns, so Catalyst plans them with everything else."""
