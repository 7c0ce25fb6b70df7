"""Python functions as verified native Spark expressions."""

_WHERE = {"served_kind": "serve", "native_udf": "serve"}
__all__ = ["canonical_source_from_func", "enable", "native_udf", "register", "register_impl", "sample", "served_kind", "shutdown", "udf"]


def __getattr__(name: str):
    """Loads what is asked for; executors that unpickle a function need none of it."""
    if name not in __all__:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_WHERE.get(name, 'api')}", __name__), name)
