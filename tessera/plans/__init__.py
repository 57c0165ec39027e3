"""Query catalogue: importing this package registers every query."""

import importlib
import pkgutil


def load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
