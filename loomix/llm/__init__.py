"""Operators of a training-data pipeline over documents, embeddings and labels."""

__all__ = ["oracle_sql", "queries"]


def __getattr__(name: str):
    """Loads the registry, and with it all operators, when it is asked for; an executor loads the one it runs."""
    if name not in __all__:
        raise AttributeError(name)
    from . import registry

    return getattr(registry, name)
