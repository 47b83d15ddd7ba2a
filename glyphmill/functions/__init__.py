"""Scalar functions: Columns in, Columns out, all inside Catalyst."""
