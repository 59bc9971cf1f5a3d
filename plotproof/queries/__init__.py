"""Named queries over the given tables."""


def load():
    """Import every query module and return the registry."""
    import importlib

    from plotproof.queries import registry

    for module in MODULES:
        importlib.import_module(f"plotproof.queries.{module}")
    return registry


MODULES = ("relational", "verification", "evidence", "printed")
