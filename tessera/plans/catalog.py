"""All registered queries of the relational engine, and their SQL: importing the modules registers them."""

from ..functions import scalar, udfs  # noqa: F401
from ..operators import ranges, relational, rollups, windows  # noqa: F401
from ..sources import formats  # noqa: F401
from ..streaming import queries, stateful  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
