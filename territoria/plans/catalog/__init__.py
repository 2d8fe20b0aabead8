"""All registered queries; importing this package fills the registry."""

from territoria.plans.catalog import climate, flows, inference, network, scoring, spatial  # noqa: F401
from territoria.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
