"""Training-data operators. Nothing outside this subpackage imports it.

``queries()`` and ``oracle_sql()`` gather what the modules here register.
"""

from __future__ import annotations

from . import registry


def queries():
    return registry.queries()


def oracle_sql():
    return registry.oracle_sql()
