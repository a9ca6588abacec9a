"""Registered queries over the driver's tables, by family, each with its SQL oracle."""
