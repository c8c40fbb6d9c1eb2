"""Page-change analytics on Spark: DataFrame in, DataFrame out."""

from changeflow.session import build_session, configure

__all__ = ["build_session", "configure"]
