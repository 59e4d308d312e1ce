"""Named queries over the driver tables (one module per area) and their oracle SQL."""

from quarry.plans import registry  # noqa: F401


def load_all():
    """Import every query module so that all keys are registered."""
    import importlib
    for m in ("conversation_queries", "table_queries", "kb_queries", "page_queries", "source_queries", "stream_queries"):
        importlib.import_module(f"quarry.plans.{m}")
    return registry.QUERIES, registry.ORACLE
