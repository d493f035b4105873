"""What was known at a time: plans, landed answers and cache entries as of each search, on any number of machines.

Times are longs (microseconds, say). Keys are cut into slices of time: within a slice a window looks back, and what earlier slices left
behind comes from a window over the slices, one row each. So a busy key is as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.config import DEFAULT, EngineConfig
from mercadia.functions.textnorm import collapsed
from mercadia.operators.search import first_word
from mercadia.plans import columns as plan_columns
from mercadia.shared import respool, spool

SECOND = 1_000_000
DAY = 86_400 * SECOND


def as_of(asked: DataFrame, entries: DataFrame, keys: list[str], value: str, slice_: int = DAY, before: bool = False, order: str = "id") -> DataFrame:
    """asked(*keys, t, ...) with `value` and its time value_t: those of the latest of entries(*keys, t, id, value) at or before t; null where there is none.

    Of entries of one time the last by id counts. before: entries of the asking's own time count only with a smaller id than its `order`. Rows with null key or time find nothing.
    """
    cut = F.expr(f"floor(t / {slice_})").alias("_slice")
    names = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    by = [f"_k{n}" for n in range(len(keys))]
    held = entries.select(*names, cut, "t", F.lit(0).alias("_ask"), F.col("id").cast("long").alias("_id"), F.struct(F.col("t").alias("t"), F.col(value).alias("v")).alias("_e")).where("t IS NOT NULL").dropna(subset=by)
    wants = asked.select(*names, cut, "t", F.lit(1).alias("_ask"), (F.col(order).cast("long") if before else F.lit(None).cast("long")).alias("_id"), F.struct("*").alias("_row"))
    # the last entry of each slice, and the last one before it
    left = held.groupBy(*by, "_slice").agg(F.max_by("_e", F.struct("t", "_id")).alias("_last"))
    slices = left.unionByName(wants.where("t IS NOT NULL").select(*by, "_slice").distinct().withColumn("_last", F.lit(None).cast(left.schema["_last"].dataType))).groupBy(*by, "_slice").agg(F.first("_last", ignorenulls=True).alias("_last"))
    carried = slices.withColumn("_carry", F.last("_last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_last").where("_carry IS NOT NULL")
    both = held.withColumn("_row", F.lit(None).cast(wants.schema["_row"].dataType)).unionByName(wants.withColumn("_e", F.lit(None).cast(held.schema["_e"].dataType)))
    place = ["t", F.coalesce("_id", F.lit(2**63 - 1)), "_ask"] if not before else ["t", "_id", F.desc("_ask")]
    seen = F.last("_e", ignorenulls=True).over(Window.partitionBy(*by, "_slice").orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_seen", seen).where("_ask = 1").select(*by, "_slice", "_row", "_seen").join(carried, [*by, "_slice"], "left")
    got = F.coalesce("_seen", "_carry")
    return found.select("_row.*", got["v"].alias(value), got["t"].alias(f"{value}_t"))


def _local(query: Column) -> Column:
    none = F.array().cast("array<array<string>>"), F.array().cast("array<string>")
    return F.struct(
        query.alias("original_query"), query.alias("canonical_query"), plan_columns.search_texts(query).alias("search_queries"), none[0].alias("required_any_groups"), none[1].alias("exclude_terms"), F.lit(0.0).alias("confidence"), F.lit("local").alias("source"),
    )


def resolve_plans(searches: DataFrame, plans: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """searches(query, t, ...) with plan, a struct of QueryPlan's fields. The latest of the cached plans(query, t, id, body) of the same text, in any case and spacing, counts if it is a JSON object and at most
    config.plan_ttl_s old, the end included: it is merged with the local plan. Otherwise, and for blank queries, the plan is local."""
    key = F.lower(collapsed(F.col("query")))
    found = as_of(searches.withColumn("_key", key), plans.withColumn("_key", key), ["_key"], "body").drop("_key")
    query = collapsed(F.col("query"))
    fresh = (F.col("t") - F.col("body_t") <= config.plan_ttl_s * SECOND) & F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("body")), F.lit("OBJECT")), F.lit(False)) & (query != "")
    found = found.withColumns({"_fresh": F.coalesce(fresh, F.lit(False)), "_local": _local(query)})
    sound = plan_columns.sanitized(F.when(F.col("_fresh"), F.col("body")))
    merged = plan_columns.merged(query, F.col("_sound"), F.col("_local.search_queries"), F.col("_sound.source"))
    return found.withColumn("_sound", sound).withColumn("plan", F.when(F.col("_fresh"), merged).otherwise(F.col("_local"))).drop("_fresh", "_local", "_sound", "body", "body_t")


def _next(requests: DataFrame, ttl: int) -> DataFrame:
    """id, to: for each successful request the first successful one of its key after its entry would have expired; none if there is none."""
    good = requests.where("ok").select("key", "t", "id")
    cut = lambda t: F.expr(f"floor({t} / {ttl + 1})").alias("slice")
    events = good.select("key", cut("t"), "t", F.lit(0).alias("probe"), "id", F.struct("t", "id").alias("e"))
    ends = good.select("key", cut(f"(t + {ttl})"), (F.col("t") + ttl).alias("t"), F.lit(1).alias("probe"), "id", F.lit(None).cast("struct<t:bigint,id:bigint>").alias("e"))
    firsts = events.groupBy("key", "slice").agg(F.min("e").alias("first"))
    slices = firsts.unionByName(ends.select("key", "slice").distinct().withColumn("first", F.lit(None).cast("struct<t:bigint,id:bigint>"))).groupBy("key", "slice").agg(F.min("first").alias("first"))
    # read backwards, so that a frame grows with each row: Spark works out one that ends with its partition anew for every row
    before = (Window.unboundedPreceding, -1)
    later = slices.withColumn("later", F.last("first", ignorenulls=True).over(Window.partitionBy("key").orderBy(F.desc("slice")).rowsBetween(*before))).drop("first")
    after = F.last("e", ignorenulls=True).over(Window.partitionBy("key", "slice").orderBy(F.desc("t"), F.desc("probe"), F.desc("id")).rowsBetween(*before))  # a probe stands behind the requests of its own time
    found = events.unionByName(ends).withColumn("after", after).where("probe = 1").join(later, ["key", "slice"], "left")
    return found.select("id", F.coalesce("after.id", "later.id").alias("to"))


def writers(requests: DataFrame, ttl: int) -> DataFrame:
    """id of the requests(key, t, id, ok) that write an entry: the first successful one of a key, and from each writer on the first successful one after its entry's end.

    Who writes next is a function of a writer's time, so the chain is found by pointer doubling: tables of the 1st, 2nd, 4th, ... successor, then from the longest leap down to the shortest all that is reached.
    A key's requests need not be in one task.
    """
    step = spool(_next(requests, ttl).where("to IS NOT NULL"), "next")
    roots = spool(requests.where("ok").groupBy("key").agg(F.min(F.struct("t", "id")).alias("s")).select(F.col("s.id").alias("id")), "roots")
    step = spool(step.join(roots.union(step.select("to")).distinct(), "id", "left_semi"), "links")  # a chain goes through no others
    leaps = []
    while not step.isEmpty():  # as many rounds as the longest chain has binary digits
        leaps.append(step)
        step = spool(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to")), "leap")
    reached, path = roots, None
    for leap in reversed(leaps):
        reached, path = respool(reached.unionByName(reached.join(leap, "id").select(F.col("to").alias("id"))), "writers", path)
    return reached


def read_through(requests: DataFrame, ttl: int) -> DataFrame:
    """requests(key, t, id, ok, ...) with hit and entry, the id of the request whose entry answers: its own where it writes one, null where it fails.

    ok: would a fetch at that time succeed? An entry answers to the end of ttl, the end included, and a hit does not renew it; only a miss that succeeds writes. Requests of one time go by id. ids are unique.
    """
    wrote = spool(writers(requests, ttl), "chain")
    entries = requests.join(wrote, "id").select("key", "t", "id", F.col("id").alias("entry"))
    found = as_of(requests, entries, ["key"], "entry", max(1, ttl), before=True)
    hit = F.coalesce(F.col("t") - F.col("entry_t") <= ttl, F.lit(False))
    return found.withColumns({"hit": hit, "entry": F.when(hit, F.col("entry")).when(F.col("ok"), F.col("id"))}).drop("entry_t")


def answered(requests: DataFrame, landings: DataFrame, bare: Column, ttl: int) -> DataFrame:
    """requests(store_key, text, t, id) with hit, ok, error and landing, the id of the landing whose answer is given, through a cache of each store and text.

    landings(store_key, text, t, id, ok, error, ...): a fetch finds the latest one of its time; none is a failure. bare, over the landing's columns: the answer is empty, so the text's first word is asked, whose result goes under the original key. A hit
    gives what was written.
    """
    known = landings.withColumn("landing", F.struct("id", F.coalesce("ok", F.lit(False)).alias("ok"), "error", F.coalesce(bare, F.lit(False)).alias("bare")))
    first = as_of(requests.withColumn("again", first_word(F.col("text"))), known, ["store_key", "text"], "landing").withColumnRenamed("landing", "first").drop("landing_t")
    both = as_of(first.withColumnsRenamed({"text": "asked", "again": "text"}), known, ["store_key", "text"], "landing").select("store_key", F.col("asked").alias("text"), "t", "id", "first", F.col("landing").alias("second"))
    anew = F.coalesce(F.col("first.ok") & F.col("first.bare"), F.lit(False)) & F.col("second").isNotNull()
    own = both.withColumn("own", F.when(anew, F.col("second")).otherwise(F.col("first"))).drop("first", "second")
    own = spool(own.withColumns({"ok": F.coalesce("own.ok", F.lit(False)), "key": F.concat_ws("::", "store_key", F.lower(F.trim("text")))}), "own-answers")
    through = read_through(own.select("key", "t", "id", "ok"), ttl).select("id", "hit", "entry")
    written = own.select(F.col("id").alias("entry"), F.col("own.id").alias("written"))
    done = own.join(through, "id").join(written, "entry", "left")
    return done.select("store_key", "text", "t", "id", "hit", (F.col("hit") | F.col("ok")).alias("ok"), F.when(~F.col("hit"), F.col("own.error")).alias("error"), F.col("written").alias("landing"))
