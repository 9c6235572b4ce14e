"""Registered queries: each pairs a Spark callable with the SQL that must give the same rows."""

from . import base  # noqa: F401


def load() -> None:
    """Import every query module so that its queries register."""
    from . import q_bank, q_coverage, q_experts, q_gates, q_geometry, q_match, q_metrics, q_policies, q_ports, q_selective, q_sets, q_shift, q_sources, q_spatial, q_stream  # noqa: F401
