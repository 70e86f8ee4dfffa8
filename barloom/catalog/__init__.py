"""Registered queries, one module per group of operators."""

import importlib
import pkgutil


def load():
    from . import base

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return base
