"""Trajectory and instruction analytics as Spark DataFrame operators."""
