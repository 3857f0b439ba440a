"""The catalogue over part, supplier, customer and events, in batch and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tilework.functions import NEVER
from tilework.operators import catalog
from tilework.operators.index import index_page, search_index, write_index
from tilework.plans.models import given_ensemble
from tilework.plans.tables import FEATURES, LINES_SQL, LOG_SQL, dirty, lines, log, renamed, table
from tilework.sources.delimited import read_delimited
from tilework.sources.shared import discard, settle, shared_dir
from tilework.streaming import jobs

LISTING_KINDS = {"signup": "listed", "purchase": "bought", "error": "cancelled"}
ACCESS_KINDS = {"signup": "access_granted", "purchase": "access_bought", "error": "access_revoked"}


def models(spark, d):
    """Each part a model: title from its name, creator and pricing from its numbers."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("token_id"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_id"), F.col("p_name").alias("title"),
        F.concat(F.lit("c"), (F.col("p_partkey") % 50).cast("string")).alias("creator"), (F.col("p_size") % 5 != 0).alias("enabled"),
        (F.col("p_size") % 3).alias("pricing_mode"), (F.col("p_size") * 100).cast("decimal(38,0)").alias("fee"),
    )


MODELS_SQL = """models AS (
  SELECT p_partkey AS token_id, 'm' || p_partkey AS model_id, p_name AS title, 'c' || (p_partkey % 50) AS creator, p_size % 5 <> 0 AS enabled, p_size % 3 AS pricing_mode, p_size * 100 AS fee FROM part
)"""


def owners(spark, d):
    """Who holds a token: the user of its last event, burned after an error in a multiple of seven."""
    moved = renamed(log(spark, d), {"purchase": "transfer", "error": "transfer"})
    burned = (F.col("event_type") == "error") & (F.col("block") % 7 == 0)
    return catalog.owners_from_transfers(moved.withColumn("counterparty", F.when(burned, catalog.BURNED).otherwise(F.col("actor"))))


OWNERS_SQL = f"""owners AS (
  SELECT token_id, arg_max(CASE WHEN event_type = 'error' AND block % 7 = 0 THEN '{catalog.BURNED}' ELSE actor END, block) AS owner
  FROM log WHERE event_type IN ('purchase', 'error') GROUP BY token_id
  HAVING arg_max(CASE WHEN event_type = 'error' AND block % 7 = 0 THEN '{catalog.BURNED}' ELSE actor END, block) <> '{catalog.BURNED}'
)"""


def listings(spark, d):
    return catalog.listings_from_events(renamed(log(spark, d), LISTING_KINDS))


LISTINGS_SQL = """closed AS (
  SELECT token_id, max(block) FILTER (event_type IN ('purchase', 'error')) AS closed FROM log WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY token_id
), listings AS (
  SELECT token_id, arg_max(amount, block) AS price, arg_min(actor, block) AS seller
  FROM log JOIN closed USING (token_id) WHERE event_type = 'signup' AND (closed IS NULL OR block > closed) GROUP BY token_id
)"""


def plans_of(spark, d):
    """Plan 0 of each model: its days come from its number."""
    return spark.range(20).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model_id"), F.lit(0).alias("plan_id"), (F.col("id") * 50 + 10).alias("duration_blocks"))


def access_events(spark, d):
    return renamed(log(spark, d), ACCESS_KINDS).withColumn("plan_id", F.lit(0))


ACCESS_SQL = """acc AS (
  SELECT block, model_id, key, event_type, row_number() OVER (PARTITION BY model_id, key ORDER BY block) AS i, CAST(substr(model_id, 2) AS BIGINT) * 50 + 10 AS dur
  FROM log WHERE event_type IN ('signup', 'purchase', 'error')
), walk AS (
  SELECT model_id, key, block, i, CAST(CASE event_type WHEN 'signup' THEN 18446744073709551615 WHEN 'error' THEN 0 ELSE block + dur END AS HUGEINT) AS expiry FROM acc WHERE i = 1
  UNION ALL
  SELECT a.model_id, a.key, a.block, a.i, CAST(CASE a.event_type WHEN 'signup' THEN 18446744073709551615 WHEN 'error' THEN 0
    ELSE CASE WHEN w.expiry = 18446744073709551615 THEN w.expiry ELSE greatest(w.expiry, a.block) + a.dur END END AS HUGEINT)
  FROM walk w JOIN acc a ON a.model_id = w.model_id AND a.key = w.key AND a.i = w.i + 1
)"""


def c_owners(spark, d):
    return owners(spark, d)


C_OWNERS = f"WITH {LOG_SQL}, {OWNERS_SQL} SELECT token_id, owner FROM owners"


def c_balances(spark, d):
    return catalog.owner_balances(owners(spark, d))


C_BALANCES = f"WITH {LOG_SQL}, {OWNERS_SQL} SELECT owner, count(*) AS balance FROM owners GROUP BY owner"


def c_listings(spark, d):
    return listings(spark, d).select("token_id", F.col("price").cast("long").alias("price"), "seller")


C_LISTINGS = f"WITH {LOG_SQL}, {LISTINGS_SQL} SELECT token_id, price, seller FROM listings"


def c_access(spark, d):
    return catalog.access_from_events(access_events(spark, d), plans_of(spark, d)).select("model_id", "key", F.col("expiry").cast("string").alias("expiry"))


C_ACCESS = f"WITH RECURSIVE {LOG_SQL}, {ACCESS_SQL} SELECT model_id, key, CAST(arg_max(expiry, i) AS VARCHAR) AS expiry FROM walk GROUP BY model_id, key"


def c_active(spark, d):
    """A signup registers a token's model; an error that nothing follows burns the token."""
    events = log(spark, d)
    last = events.groupBy("token_id").agg(F.max_by("event_type", "block").alias("event_type"), F.max("block").alias("block"))
    burned = last.filter("event_type = 'error'").select("token_id", F.lit(None).cast("string").alias("model_id"), F.lit("burned").alias("kind"))
    registered = renamed(events, {"signup": "registered"}).select("token_id", "model_id", "kind")
    return catalog.active_models(registered.unionByName(burned)).select("token_id", "model_id")


C_ACTIVE = f"""WITH {LOG_SQL} SELECT DISTINCT token_id, model_id FROM log
WHERE event_type = 'signup' AND token_id NOT IN (SELECT token_id FROM log GROUP BY token_id HAVING arg_max(event_type, block) = 'error')"""


def c_plans(spark, d):
    events = renamed(log(spark, d), {"signup": "plan_set", "error": "plan_off"}).withColumn("plan_id", (F.col("token_id") % 3).cast("int"))
    return catalog.current_plans(events).select("model_id", "plan_id", F.col("price").cast("long").alias("price"), "active")


C_PLANS = f"""WITH {LOG_SQL} SELECT model_id, CAST(token_id % 3 AS INTEGER) AS plan_id, arg_max(amount, block) AS price, arg_max(event_type = 'signup', block) AS active
FROM log WHERE event_type IN ('signup', 'error') GROUP BY 1, 2"""


def c_postings(spark, d):
    return catalog.build_postings(models(spark, d))


C_POSTINGS = """WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word, generate_subscripts(string_split(lower(p_name), ' '), 1) - 1 AS i FROM part),
f AS (SELECT p_partkey, word, min(i) AS i FROM w WHERE length(word) >= 2 GROUP BY 1, 2)
SELECT word, p_partkey AS token_id, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS INTEGER) AS pos FROM f"""


def j_search(spark, d):
    m = models(spark, d)
    return catalog.search_titles(catalog.build_postings(m), ["Red", "widget"], m.filter("enabled").select("token_id"))


J_SEARCH = "SELECT p_partkey AS token_id FROM part WHERE contains(' ' || lower(p_name) || ' ', ' red ') AND contains(' ' || lower(p_name) || ' ', ' widget ') AND p_size % 5 <> 0"


def j_search_listed(spark, d):
    return catalog.search_listed(catalog.build_postings(models(spark, d)), listings(spark, d), ["red"]).select("token_id", F.col("price").cast("long").alias("price"), "seller")


J_SEARCH_LISTED = f"WITH {LOG_SQL}, {LISTINGS_SQL} SELECT token_id, price, seller FROM listings JOIN part ON p_partkey = token_id WHERE contains(' ' || lower(p_name) || ' ', ' red ')"


def _index(spark, d):
    path = f"{_folder(spark)}/index"
    write_index(models(spark, d), path)
    return path


def j_search_index(spark, d):
    """Enabled models and their prices by two words, through the stored index."""
    hits = search_index(spark, _index(spark, d), ["Red", "widget"])
    enabled = models(spark, d).filter("enabled").select("token_id", "title")
    return hits.join(enabled, "token_id").join(listings(spark, d), "token_id", "left").select("token_id", "title", F.col("price").cast("long").alias("price"))


J_SEARCH_INDEX = f"""WITH {LOG_SQL}, {LISTINGS_SQL} SELECT p_partkey AS token_id, p_name AS title, price FROM part LEFT JOIN listings ON token_id = p_partkey
WHERE contains(' ' || lower(p_name) || ' ', ' red ') AND contains(' ' || lower(p_name) || ' ', ' widget ') AND p_size % 5 <> 0"""


def l_index_page(spark, d):
    """Three pages behind each other, each from the last token of the one before."""
    path, pages, after = _index(spark, d), None, None
    for n in range(3):
        page = index_page(spark, path, ["red"], after, 7)
        after = page.agg(F.max("token_id")).first()[0]
        page = page.select("token_id", F.lit(n).alias("page"))
        pages = page if pages is None else pages.union(page)
    return pages


L_INDEX_PAGE = """WITH r AS (SELECT p_partkey AS token_id, row_number() OVER (ORDER BY p_partkey) AS i FROM part WHERE contains(' ' || lower(p_name) || ' ', ' red '))
SELECT token_id, CAST((i - 1) // 7 AS INTEGER) AS page FROM r WHERE i <= 21"""


def _cards(spark, d):
    return catalog.catalog_cards(models(spark, d).filter("enabled"), owners(spark, d), listings(spark, d))


def j_cards(spark, d):
    return _cards(spark, d).select("token_id", "title", "owner", F.col("price").cast("long").alias("price"))


J_CARDS = f"WITH {LOG_SQL}, {OWNERS_SQL}, {LISTINGS_SQL}, {MODELS_SQL} SELECT token_id, title, owner, price FROM models JOIN owners USING (token_id) LEFT JOIN listings USING (token_id) WHERE enabled"


def j_filter(spark, d):
    return catalog.filter_catalog(_cards(spark, d), creator="c7", words=["red"], postings=catalog.build_postings(models(spark, d))).select("token_id", "owner")


J_FILTER = f"WITH {LOG_SQL}, {OWNERS_SQL}, {MODELS_SQL} SELECT token_id, owner FROM models JOIN owners USING (token_id) WHERE enabled AND creator = 'c7' AND contains(' ' || lower(title) || ' ', ' red ')"


def j_purchasable(spark, d):
    ok = catalog.purchasable_listings(listings(spark, d), owners(spark, d)).select("token_id", F.lit(True).alias("open"))
    return ok.union(catalog.stale_listings(listings(spark, d), owners(spark, d)).select("token_id", F.lit(False)))


J_PURCHASABLE = f"WITH {LOG_SQL}, {OWNERS_SQL}, {LISTINGS_SQL} SELECT token_id, coalesce(owner = seller, false) AS open FROM listings LEFT JOIN owners USING (token_id)"


def _requests(spark, d):
    e = log(spark, d).filter("event_type in ('view', 'click')")
    kind = F.when(F.col("block") % 3 == 0, "view").when(F.col("block") % 3 == 1, "paid").otherwise("access")
    return e.select(F.col("block").cast("string").alias("request_id"), "block", "model_id", F.col("actor").alias("caller"), "key", kind.alias("kind"), (F.col("amount") % 5000).alias("value"))


REQUESTS_SQL = """requests AS (
  SELECT CAST(block AS VARCHAR) AS request_id, block, model_id, actor AS caller, key, CASE block % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'paid' ELSE 'access' END AS kind, amount % 5000 AS value
  FROM log WHERE event_type IN ('view', 'click')
), asked AS (
  SELECT r.*, coalesce(w.expiry, 0) AS expiry FROM requests r ASOF LEFT JOIN walk w ON r.model_id = w.model_id AND r.key = w.key AND r.block >= w.block
)"""


def j_access_at(spark, d):
    history = catalog.access_history(access_events(spark, d), plans_of(spark, d))
    return catalog.access_at(_requests(spark, d), history).select("request_id", F.col("expiry").cast("string").alias("expiry"), "valid")


J_ACCESS_AT = f"""WITH RECURSIVE {LOG_SQL}, {ACCESS_SQL}, {REQUESTS_SQL}
SELECT request_id, CAST(expiry AS VARCHAR) AS expiry, expiry = {NEVER} OR (expiry >= block AND expiry > 0) AS valid FROM asked"""


def j_gate(spark, d):
    history = catalog.access_history(access_events(spark, d), plans_of(spark, d))
    return catalog.gate_requests(_requests(spark, d), models(spark, d), owners(spark, d), history).select("request_id", "allowed", "reason")


J_GATE = f"""WITH RECURSIVE {LOG_SQL}, {ACCESS_SQL}, {REQUESTS_SQL}, {OWNERS_SQL}, {MODELS_SQL}, g AS (
  SELECT a.request_id, CASE WHEN m.enabled IS NULL THEN 'unknown' WHEN NOT m.enabled THEN 'disabled' WHEN kind = 'view' AND pricing_mode = 2 THEN 'paid_only'
    WHEN kind = 'paid' AND pricing_mode = 2 AND value < fee AND NOT coalesce(caller = owner, false) THEN 'fee' WHEN kind = 'access' AND pricing_mode <> 2 THEN 'mode'
    WHEN kind = 'access' AND NOT (expiry = {NEVER} OR (expiry >= block AND expiry > 0)) THEN 'no_access' ELSE 'ok' END AS reason
  FROM asked a LEFT JOIN models m USING (model_id) LEFT JOIN owners o USING (token_id)
)
SELECT request_id, reason = 'ok' AS allowed, reason FROM g"""


def l_page(spark, d):
    return catalog.page(listings(spark, d).select("token_id"), "token_id", 1, 10)


L_PAGE = f"WITH {LOG_SQL}, {LISTINGS_SQL}, r AS (SELECT token_id, row_number() OVER (ORDER BY token_id) AS i, count(*) OVER () AS n FROM listings) SELECT token_id, CAST(CASE WHEN n > 20 THEN 2 ELSE 0 END AS INTEGER) AS next_page FROM r WHERE i BETWEEN 11 AND 20"


def l_search_page(spark, d):
    return catalog.search_page(catalog.search_titles(catalog.build_postings(models(spark, d)), ["red"]), 5, 20)


L_SEARCH_PAGE = "SELECT p_partkey AS token_id FROM part WHERE contains(' ' || lower(p_name) || ' ', ' red ') ORDER BY p_partkey LIMIT 20 OFFSET 5"

# ---- streams ----------------------------------------------------------------


def _folder(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _streamed(spark, df, label, batches=None):
    """A written table as a stream of files, in so many micro-batches if that is said."""
    path = f"{_folder(spark)}/{label}"
    (df.repartition(batches) if batches else df).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", 1) if batches else reader).parquet(path)


def _run(query) -> int:
    """The number of the last micro-batch."""
    query.awaitTermination()
    return max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=0)


LATENESS = 400  # blocks


def t_stream_access(spark, d):
    """Events that come up to LATENESS blocks out of order, over six micro-batches: the state ends where the batch job does."""
    events = access_events(spark, d).join(F.broadcast(plans_of(spark, d)), ["model_id", "plan_id"])
    moved = settle(events.withColumn("at", F.col("block") + F.pmod(F.xxhash64("block"), F.lit(LATENESS))), "moved")
    last = moved.agg(F.max("at")).first()[0] or 0
    path, out = f"{_folder(spark)}/access", _folder(spark)
    for i in range(6):  # files of one time after another, as they would come; the stream goes on from its checkpoint
        moved.filter(F.floor(F.col("at") * 6 / (last + 1)) == i).drop("at").write.mode("append").parquet(path)
        stream = jobs.stream_access(spark.readStream.schema(events.schema).parquet(path), LATENESS)
        _run(stream.writeStream.outputMode("update").foreachBatch(jobs.keep_batches(f"{out}/out")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    discard(moved)
    return jobs.current_access(spark.read.parquet(f"{out}/out")).select("model_id", "key", "expiry")


T_STREAM_ACCESS = C_ACCESS


def t_stream_listings(spark, d):
    events = renamed(log(spark, d), LISTING_KINDS)
    out = _folder(spark)
    writer = jobs.stream_listings(_streamed(spark, events, "listings", 3), f"{out}/listings", f"{out}/state")
    _run(writer.trigger(availableNow=True).start())
    return jobs.current_listings(spark, f"{out}/listings").select("token_id", F.col("price").cast("long").alias("price"), "seller")


T_STREAM_LISTINGS = C_LISTINGS


def t_stream_score(spark, d):
    rows = lines(spark, d).select("row_id", *FEATURES)
    out = _folder(spark)
    scored = jobs.stream_score(_streamed(spark, rows, "requests"), given_ensemble()).select("row_id", F.col("score_q")[0].alias("q"))
    _run(scored.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/out")


def t_stream_clean(spark, d):
    rows = dirty(spark, d).select("row_id", "a", "b")
    out = _folder(spark)
    run = jobs.clean_batches("regression", ["a"], ["b"], (), f"{out}/kept", f"{out}/report")
    _run(_streamed(spark, rows, "dirty").writeStream.foreachBatch(run).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/report").groupBy("reason").agg(F.sum("n").cast("long").alias("n"))


def s_delimited(spark, d):
    """Written as text with ';' and read back: the delimiter is found, blank rows go."""
    path = f"{_folder(spark)}/csv"
    rows = dirty(spark, d).select(F.col("a").alias(" a "), "b", F.concat(F.lit('say "'), "l_returnflag", F.lit('"; x')).alias("note"))
    rows.repartition(4).write.csv(path, sep=";", header=True, escape='"', nullValue="", emptyValue="")
    return read_delimited(spark, path).groupBy("a", "note").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("b") == "").cast("int")).cast("long").alias("empty"))


from tilework.plans import models as _m, profiles as _p  # noqa: E402
from tilework.plans.tables import DIRTY_SQL  # noqa: E402

T_STREAM_SCORE = f"WITH {_m.GIVEN_SQL} SELECT row_id, CAST(s0 AS BIGINT) AS q FROM given"
T_STREAM_CLEAN = _p.P_DROP_REGRESSION
S_DELIMITED = f"""WITH {LINES_SQL}, {DIRTY_SQL} SELECT trim(a) AS a, 'say "' || l_returnflag || '"; x' AS note, count(*) AS n, CAST(count(*) FILTER (b IS NULL) AS BIGINT) AS empty FROM dirty GROUP BY 1, 2"""

QUERIES = {k: v for k, v in globals().items() if k[:2] in ("c_", "j_", "l_", "t_", "s_") and callable(v)}
SQL = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
