"""Queries; importing this package registers all of them."""

from . import catalogue, extra, further, more  # noqa: F401
