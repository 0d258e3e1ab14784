from .ingest import activity, ingest

__all__ = ["activity", "ingest"]
