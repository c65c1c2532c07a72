"""weftaudit: website audits as Spark DataFrame jobs."""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
