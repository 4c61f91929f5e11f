"""Multi-tenant document retrieval by embedding, expressed as Spark jobs."""

from docfathom.session import build_session, checkpoint_dir, materialize, ship_package

__all__ = ["build_session", "checkpoint_dir", "materialize", "ship_package"]
