"""Price-table build: the configured tables in one pass over the export."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tallyforge.operators import prices
from tallyforge.session import settle
from tallyforge.sources.sinks import write_price_table

#: Configured step and the table it builds.
STEPS = {f"build_{name}_pricing": name for name in prices.TABLES}


def build_price_tables(sku_export: DataFrame, steps: Iterable[str] | None = None,
                       target: str | None = None) -> dict[str, DataFrame]:
    """Price tables of the configured steps, in the order given.

    An unknown step fails before anything is read. All tables come from one scan and one
    shuffle, written in a folder per table; each returned table reads its own
    folder. With ``target`` (a folder, or a ``database.`` prefix) they replace
    the tables there, one after another, so a failure leaves whole tables, old or new.
    """
    chosen = list(STEPS if steps is None else steps)
    unknown = [s for s in chosen if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    names = [STEPS[s] for s in chosen]
    if not names:
        return {}
    rows = settle(prices.price_rows(sku_export, names), "price-rows", ("price_table",))
    tables: dict[str, DataFrame] = {}
    for name in names:
        df = prices.table_of(rows, name)
        if target is not None:
            place = f"{target}{name}_pricing" if target.endswith(".") else f"{target.rstrip('/')}/{name}_pricing"
            df = write_price_table(df, place)
        tables[name] = df
    return tables


def all_prices(price_tables: dict[str, DataFrame]) -> DataFrame:
    """The tables under common columns, for an overview: one row per price."""
    union = None
    for name, df in price_tables.items():
        key = next(c for c in df.columns if c in ("cpu", "gpu", "pd", "ip_key", "lic_key"))
        rows = df.selectExpr(f"'{name}' AS price_table", f"{key} AS price_key", "sku_id", "max_usd", "min_usd",
                             "pricing_unit")
        union = rows if union is None else union.unionByName(rows)
    return union
