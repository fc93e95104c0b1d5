"""Column expressions: shares and labels, rounding, missing values, dates, distances."""

from .expressions import *  # noqa: F403
from .geo import *  # noqa: F403
