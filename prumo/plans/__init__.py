"""Registered queries by subject."""

from importlib import import_module

SUBJECTS = ("texts", "pages", "quotes", "searching", "triaging", "listings", "merging", "pacing", "sourcing")


def load():
    from prumo.plans.registry import ORACLES, QUERIES

    for subject in SUBJECTS:
        import_module(f"prumo.plans.{subject}")
    return dict(QUERIES), dict(ORACLES)
