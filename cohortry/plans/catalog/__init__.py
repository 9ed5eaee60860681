"""The registered queries, one module per operator family."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every catalog module, which registers its queries."""
    for module in sorted(m.name for m in iter_modules(__path__)):
        import_module(f"{__name__}.{module}")
