"""Importing this module fills the registry."""

from gapwright.bindings import changes, cleaning, relational, reports  # noqa: F401
