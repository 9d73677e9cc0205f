"""Tool names as they are meant; the resolver is the core's."""

from loomwork.functions.toolnames import Catalog, catalog, flow_steps, folded, key, slips

__all__ = ["Catalog", "catalog", "flow_steps", "folded", "key", "slips"]
