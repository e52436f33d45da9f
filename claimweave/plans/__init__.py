"""Queries over the driver tables, one module per operator family."""

from importlib import import_module

from claimweave.plans.catalogue import BUILDERS, COVERS, SQL, Tables, as_callable

MODULES = ("similarity", "filters", "windows", "joins", "aggregates", "ranking", "graphs", "quality", "fingerprints", "builders", "streams", "scalars", "scans")

for _name in MODULES:
    import_module(f"claimweave.plans.{_name}")

__all__ = ["BUILDERS", "COVERS", "SQL", "Tables", "as_callable"]
