"""Accelerator-fleet telemetry analytics on Spark DataFrames."""

from fleetlens.session import build_session, materialize

__all__ = ["build_session", "materialize"]
