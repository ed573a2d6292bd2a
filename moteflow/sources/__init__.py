"""Readers of trajectories, logs and result tables."""
