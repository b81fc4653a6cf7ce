"""Wayfold: agent-run trajectories, their checkpoints and deltas, as Spark DataFrames."""
