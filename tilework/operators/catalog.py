"""The model catalogue: state from event logs, search, listings, gated requests.

Events are ordered by (block, log_index). Amounts are DECIMAL(38,0), block
numbers that may mean "never" DECIMAL(20,0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.functions import title_words
from tilework.operators.access import access_at, access_from_events, access_history  # noqa: F401  part of the catalogue

BURNED = "0x0000000000000000000000000000000000000000"


def _when() -> Column:
    return F.struct("block", "log_index")


def owners_from_transfers(events: DataFrame) -> DataFrame:
    """(token_id, owner) after the last transfer of each token; burned tokens go."""
    last = events.filter(F.col("kind") == "transfer").groupBy("token_id").agg(F.max_by("counterparty", _when()).alias("owner"))
    return last.filter(F.col("owner") != BURNED)


def owner_balances(owners: DataFrame) -> DataFrame:
    return owners.groupBy("owner").agg(F.count(F.lit(1)).alias("balance"))


def listings_from_events(events: DataFrame) -> DataFrame:
    """(token_id, price, seller) of open listings.

    The last event of a token decides; a listing anew changes the price and
    keeps the seller of the first since the last one was closed.
    """
    mine = events.filter(F.col("kind").isin("listed", "cancelled", "bought"))
    closed = F.max(F.when(F.col("kind") != "listed", _when()))
    ends = mine.groupBy("token_id").agg(closed.alias("closed"), F.max(_when()).alias("last"))
    open_ = mine.filter(F.col("kind") == "listed").join(ends.filter("closed is null or closed < last"), "token_id")
    live = open_.filter(F.col("closed").isNull() | (_when() > F.col("closed")))
    return live.groupBy("token_id").agg(F.max_by("amount", _when()).alias("price"), F.min_by("actor", _when()).alias("seller"))


def build_postings(models: DataFrame) -> DataFrame:
    """(word, token_id, pos): each distinct title word of each token."""
    return models.select("token_id", F.posexplode(title_words("title")).alias("pos", "word")).select("word", "token_id", "pos")


def active_models(events: DataFrame) -> DataFrame:
    """(token_id, model_id) registered and not burned."""
    burned = events.filter(F.col("kind") == "burned").select("token_id").distinct()
    return events.filter(F.col("kind") == "registered").select("token_id", "model_id").distinct().join(burned, "token_id", "left_anti")


def current_plans(events: DataFrame) -> DataFrame:
    """(model_id, plan_id, price, active) by the last event of each plan."""
    last = events.filter(F.col("kind").isin("plan_set", "plan_off")).groupBy("model_id", "plan_id")
    return last.agg(F.max_by("amount", _when()).alias("price"), F.max_by(F.col("kind") == "plan_set", _when()).alias("active"))


def search_titles(postings: DataFrame, words: Sequence[str], active: DataFrame | None = None) -> DataFrame:
    """Tokens whose titles hold all words."""
    words = list(dict.fromkeys(w.lower() for w in words if len(w) >= 2))
    hits = postings.filter(F.col("word").isin(*words)).groupBy("token_id").agg(F.count_distinct("word").alias("n"))
    hits = hits.filter(F.col("n") == len(words)).select("token_id") if words else postings.select("token_id").distinct().limit(0)
    return hits.join(active, "token_id", "left_semi") if active is not None else hits


def search_listed(postings: DataFrame, listings: DataFrame, words: Sequence[str]) -> DataFrame:
    return search_titles(postings, words).join(listings, "token_id")


def catalog_cards(models: DataFrame, owners: DataFrame, listings: DataFrame) -> DataFrame:
    """Active models with their owner and, where listed, the price."""
    return models.join(owners, "token_id").join(listings.select("token_id", "price"), "token_id", "left")


def filter_catalog(cards: DataFrame, owner: str | None = None, creator: str | None = None, words: Sequence[str] = (), postings: DataFrame | None = None) -> DataFrame:
    if owner:
        cards = cards.filter(F.col("owner") == owner)
    if creator:
        cards = cards.filter(F.col("creator") == creator)
    if words:
        cards = cards.join(search_titles(postings, words), "token_id", "left_semi")
    return cards


def purchasable_listings(listings: DataFrame, owners: DataFrame) -> DataFrame:
    """Listings whose seller still owns the token."""
    return listings.join(owners, (listings["token_id"] == owners["token_id"]) & (F.col("seller") == F.col("owner")), "left_semi")


def stale_listings(listings: DataFrame, owners: DataFrame) -> DataFrame:
    return listings.join(owners, (listings["token_id"] == owners["token_id"]) & (F.col("seller") == F.col("owner")), "left_anti")


def gate_requests(requests: DataFrame, models: DataFrame, owners: DataFrame, history: DataFrame) -> DataFrame:
    """requests (request_id, block, model_id, caller, key, kind, value) with allowed and reason.

    kind is view, paid or access. Reasons in the order of their checks:
    unknown model, disabled, paid_only (a free view of a paid model), fee (less
    than the price from another than the owner), mode (access to a model that
    is not paid), no_access.
    """
    known = models.select("model_id", "token_id", "enabled", "pricing_mode", "fee").join(owners, "token_id", "left")
    with_access = access_at(requests, history)
    r = with_access.join(known, "model_id", "left")
    paid = F.col("pricing_mode") == 2
    owner = F.coalesce(F.col("caller") == F.col("owner"), F.lit(False))
    reason = (
        F.when(F.col("enabled").isNull(), "unknown")
        .when(~F.col("enabled"), "disabled")
        .when((F.col("kind") == "view") & paid, "paid_only")
        .when((F.col("kind") == "paid") & paid & (F.col("value") < F.col("fee")) & ~owner, "fee")
        .when((F.col("kind") == "access") & ~paid, "mode")
        .when((F.col("kind") == "access") & ~F.col("valid"), "no_access")
        .otherwise("ok")
    )
    return r.select("request_id", "model_id", "key", "block", (reason == "ok").alias("allowed"), reason.alias("reason"))


def page(df: DataFrame, order: str, number: int, size: int = 25) -> DataFrame:
    """Page ``number`` (from 0) in the order of a unique column, with the next one's number (0 at the end)."""
    rows = df.orderBy(order).offset(number * size).limit(size + 1)
    ranked = rows.withColumn("_r", F.row_number().over(W.orderBy(order)))  # size + 1 rows
    more = F.max("_r").over(W.partitionBy()) > size
    return ranked.withColumn("next_page", F.when(more, number + 1).otherwise(0)).filter(F.col("_r") <= size).drop("_r")


def search_page(hits: DataFrame, cursor: int, limit: int) -> DataFrame:
    return hits.orderBy("token_id").offset(cursor).limit(limit)
