"""tessera: public-registry analytics as Spark DataFrame jobs."""

__all__ = ["session"]
