"""Column functions."""

from .scalar import *  # noqa: F403
