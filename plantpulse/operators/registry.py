"""Asset and signal registries: nested read models and referential checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import nest_pages, newest

SIGNAL_COLUMNS = ["signal_id", "unit", "sampling_class"]


def asset_detail(assets: DataFrame, signals: DataFrame, asset_id: str | None = None) -> DataFrame:
    """Each asset with its signals ordered by id; without signals the array is empty."""
    if asset_id is not None:
        assets = assets.filter(F.col("asset_id") == asset_id)
        signals = signals.filter(F.col("asset_id") == asset_id)
    nested = nest_pages(signals, ["asset_id"], ["signal_id"], SIGNAL_COLUMNS, "signals")
    none = F.array().cast(nested.schema["signals"].dataType)
    return assets.join(nested, "asset_id", "left").select(
        "asset_id", "site_id", "area_id", "name",
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("signals", none).alias("signals"),
    )


def asset_signals(signals: DataFrame, asset_id: str) -> DataFrame:
    """The signals of one asset, ordered by id."""
    return signals.filter(F.col("asset_id") == asset_id).select(*SIGNAL_COLUMNS).orderBy("signal_id")


def latest_sites(site_health: DataFrame) -> DataFrame:
    """Name and status of each site from its newest health row."""
    rows = newest(site_health, ["site_id"], ["updated_at", "site_name", "status"], ["site_name", "status"])
    return rows.withColumnRenamed("site_name", "name")


def site_tree(site_health: DataFrame, assets: DataFrame, signals: DataFrame, site_id: str | None = None) -> DataFrame:
    """Sites with their assets, each asset with its nested signals: one row per asset page.

    The site level stays flat, because a site may own any number of assets.
    """
    sites = latest_sites(site_health)
    if site_id is not None:
        sites = sites.filter(F.col("site_id") == site_id)
        assets = assets.filter(F.col("site_id") == site_id)
    details = asset_detail(assets, signals).withColumnRenamed("name", "asset_name")
    return sites.withColumnsRenamed({"name": "site_name", "status": "site_status"}).join(details, "site_id", "left")


def orphan_signals(signals: DataFrame, assets: DataFrame) -> DataFrame:
    """Signals whose asset is not registered."""
    return signals.join(assets.select("asset_id"), "asset_id", "left_anti")


def owned_signals(signals: DataFrame, assets: DataFrame) -> DataFrame:
    """Signals whose asset is registered; removing an asset removes its signals."""
    return signals.join(assets.select("asset_id"), "asset_id", "left_semi")
