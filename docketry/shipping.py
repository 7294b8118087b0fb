"""Task functions travel with the job instead of being imported on executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_tasks(module_name: str) -> None:
    """Serialize the functions of a module by value.

    Executors then need pandas and numpy but not an installed copy of this
    package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
