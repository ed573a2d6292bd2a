"""Structured Streaming forms: following growing trajectories and logs."""
