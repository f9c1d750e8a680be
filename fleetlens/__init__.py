"""fleetlens: software supply-chain analytics for a whole fleet of repositories, as Spark DataFrame jobs."""

__version__ = "0.1.0"
