"""terraspan: catalogue, registry and coverage analytics for remote-sensing files on Spark."""

__version__ = "0.1.0"
