"""Inventory end to end: landed pages to the machine state that a controller run starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyforge.operators import inventory as I
from tallyforge.sources.inventory import flatten_vm_inventory, machine_type_dim, with_machine_type


def inventory_state(state: DataFrame, pages: DataFrame, machine_types: DataFrame, enabled: DataFrame | None = None) -> DataFrame:
    """The known machines brought up to date by a listing.

    ``pages`` (project_id, inventory_time, raw_json) is the whole listing of the
    enabled projects, ``machine_types`` the landed type descriptions that sizes
    come from. Machines the listing lacks are pruned; projects outside
    ``enabled`` keep what they had.
    """
    listing = with_machine_type(flatten_vm_inventory(pages), machine_type_dim(machine_types)).select(state.columns)
    return I.prune_vms(I.upsert_vms(state, listing), listing, enabled)
