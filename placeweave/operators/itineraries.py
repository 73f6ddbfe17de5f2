"""Trip plans: listing, reading with ownership rules, and applying batches of changes.

Changes to one plan act in order, and each sees what the ones before it did. That order is not
replayed: one busy plan may own most of the batch. What a request meets follows from a few
facts that partial aggregates can find. Each delete ends a life of the plan, so the life of a
request is the number of deletes before it. Within a life the plan exists from the first
create or upsert (or from the start, if the snapshot had it), and belongs to whoever that
request named, else to the first user who claims it afterwards. With existence and owner
known, every outcome is a column, and each field ends with the last value written to it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.operators.skew import cut_lineage, lookup_join, with_totals

LISTS = ("destinations", "hotels", "mandatory_pois", "ideas")
OBJECTS = ("dates", "travelers", "preferences", "flags", "plan")
JSON_FIELDS = ("destinations", "dates", "travelers", "preferences", "flags", "hotels",
               "mandatory_pois", "ideas", "plan")
FIELDS = ("title", *JSON_FIELDS)
META_FIELDS = ("title", "dates", "travelers", "preferences", "flags", "hotels", "mandatory_pois", "ideas")
COLUMNS = ("id", "created_at", "updated_at", "user_id", *FIELDS, "status")
OPS = ("create", "update", "upsert", "delete", "update_meta", "update_plan", "claim", "soft_delete")
_OWNED_OPS = ("update_meta", "update_plan", "soft_delete")


def _page(rows: DataFrame, limit: int, offset: int, columns) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = rows.orderBy(F.col("updated_at").desc_nulls_first(), "id").offset(offset).limit(limit)
    return page.withColumn("total_count", total).select(*columns, "total_count")


def list_itineraries(itineraries: DataFrame, user=None, status: str | None = "active",
                     limit: int = 20, offset: int = 0) -> DataFrame:
    """Latest plans first; no user means everyone's, no status means any."""
    rows = itineraries
    if user is not None:
        rows = rows.filter(F.col("user_id") == F.lit(user))
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return _page(rows, limit, offset,
                 ("id", "created_at", "updated_at", "title", "destinations", "dates", "status"))


def list_user_itineraries(itineraries: DataFrame, user, status: str | None = "active",
                          limit: int = 20, offset: int = 0) -> DataFrame:
    """One user's plans, latest first; no user means none."""
    rows = itineraries.filter(F.lit(False) if user is None else F.col("user_id") == F.lit(user))
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return _page(rows, limit, offset,
                 ("id", "title", "destinations", "dates", "status", "created_at", "updated_at"))


def is_forbidden(owner, user, guest_policy: str = "documented") -> Column:
    """Is the plan someone else's? By the documented rule a guest (no user) may not touch an
    owned plan. `as_coded` lets guests through, as a comparison with null does."""
    if guest_policy not in ("documented", "as_coded"):
        raise ValueError(f"unknown guest policy: {guest_policy}")
    owner, user = F.col(owner), F.col(user)
    differs = F.coalesce(owner != user, F.lit(guest_policy == "documented"))
    return owner.isNotNull() & differs


def read_itineraries(requests: DataFrame, itineraries: DataFrame, guest_policy: str = "documented",
                     request_id: str = "request_id") -> DataFrame:
    """Answer read requests (request_id, id, user_id) with the plan and an access status; the
    plan's columns are null unless the status is ok. Requests for one popular plan are spread."""
    asked = requests.select(request_id, F.col("id").alias("_id"), F.col("user_id").alias("_user"))
    plans = itineraries.select(F.col("id").alias("_id"), F.lit(True).alias("_found"),
                               *[F.col(c) for c in COLUMNS])
    # A missing id finds nothing; its rows get keys of their own.
    keyed = asked.withColumn("_alone", F.when(F.col("_id").isNull(), F.xxhash64(request_id)).otherwise(F.lit(0)))
    met = lookup_join(keyed, plans.withColumn("_alone", F.lit(0).cast("bigint")), ["_id", "_alone"], request_id, "left")
    status = (
        F.when(F.col("_found").isNull(), "not_found")
        .when(is_forbidden("user_id", "_user", guest_policy), "forbidden").otherwise("ok")
    )
    met = met.withColumn("access_status", status)
    shown = [F.when(F.col("access_status") == "ok", F.col(c)).alias(c) for c in COLUMNS]
    return met.select(request_id, *shown, "access_status")


def _with_lives(requests: DataFrame, chunks: int) -> DataFrame:
    """Add `life`, the number of earlier deletes of the same plan, and `last_life`, the number
    of all. Requests are dealt into ranges of `seq` with about as many rows each; deletes are
    counted per plan and range, the counts are summed up over the ranges, and only within a
    range are a plan's requests put in order. The ranges are written, so that all later steps
    see the same ones."""
    cut = cut_lineage(requests.repartitionByRange(chunks, "seq").withColumn("_chunk", F.spark_partition_id()))
    deletes = (F.col("op") == "delete").cast("int")
    counts = cut.groupBy("id", "_chunk").agg(F.sum(deletes).alias("n"))
    earlier = Window.partitionBy("id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        "id", "_chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("n").over(Window.partitionBy("id")).alias("last_life"))
    inside = Window.partitionBy("id", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.withColumn("_inside", F.coalesce(F.sum(deletes).over(inside), F.lit(0)))
    return counted.join(before, ["id", "_chunk"]).withColumn(
        "life", (F.col("_before") + F.col("_inside")).cast("long")).drop("_chunk", "_before", "_inside")


def _with_state(requests: DataFrame, snapshot: DataFrame, chunks: int) -> DataFrame:
    """Add what each request meets: `present` and `owner`, and `born` (seq of its life's birth)."""
    had = snapshot.select("id", F.col("user_id").alias("_owner0"), F.lit(True).alias("_had"))
    lives = lookup_join(_with_lives(requests, chunks), had, "id", "seq", "left")
    old = (F.col("life") == 0) & F.coalesce("_had", F.lit(False))
    lives = lives.withColumn("_old", old)
    makes = F.when(F.col("op").isin("create", "upsert"), F.col("seq"))
    birth = F.min(F.when(makes.isNotNull(), F.struct(makes.alias("seq"), F.col("user_id").alias("user"))))
    lives = with_totals(lives, ["id", "life"], "seq", {"birth": birth}, {"birth": F.min("birth")})
    lives = lives.withColumns({
        # A plan from the snapshot was there before any request.
        "born": F.when(F.col("_old"), F.lit(None).cast("long")).otherwise(F.col("birth.seq")),
        "_first_owner": F.when(F.col("_old"), F.col("_owner0")).otherwise(F.col("birth.user")),
    })
    alive = F.col("_old") | (F.col("born") < F.col("seq"))
    lives = lives.withColumn("present", F.coalesce(alive, F.lit(False)))
    claim = F.min(F.when((F.col("op") == "claim") & F.col("user_id").isNotNull() & F.col("present"),
                         F.struct(F.col("seq").alias("seq"), F.col("user_id").alias("user"))))
    lives = with_totals(lives, ["id", "life"], "seq", {"claim": claim}, {"claim": F.min("claim")})
    claimed = F.when(F.col("claim.seq") < F.col("seq"), F.col("claim.user"))
    owner = F.when(F.col("present"), F.coalesce("_first_owner", claimed))
    return lives.withColumn("owner", owner).drop("_owner0", "_had", "birth", "claim", "_first_owner")


def _with_outcome(met: DataFrame, guest_policy: str) -> DataFrame:
    op, present = F.col("op"), F.col("present")
    code = (
        F.when(~op.isin(*OPS) | op.isNull(), "unknown_op")
        .when(op == "create", F.when(present, "duplicate_id").otherwise("ok"))
        .when(op == "upsert", "ok")
        .when((op == "claim") & F.col("user_id").isNull(), "invalid_user")
        .when(~present, "not_found")
        .when(op == "claim",
              F.when(F.col("owner").isNull(), "ok")
              .when(F.col("owner") == F.col("user_id"), "already_owned").otherwise("forbidden"))
        .when(op.isin(*_OWNED_OPS) & is_forbidden("owner", "user_id", guest_policy), "forbidden")
        .otherwise("ok")
    )
    return met.withColumn("error_code", code).withColumn(
        "success", F.col("error_code").isin("ok", "already_owned"))


def _default(field: str) -> str:
    return "''" if field == "title" else "'[]'" if field in LISTS else "'{}'"


def _last_write(field: str, preserve_missing: bool) -> Column:
    """The last value written to a field, as {seq, v}, over requests that took effect. What an
    operation writes, in order: a new plan gets the given value or the default; an upsert of
    an existing plan resets what is missing, or leaves it; a plain update leaves it."""
    made = "(op = 'create' OR (op = 'upsert' AND NOT present))"
    if field == "status":
        writes = f"{made} OR op = 'soft_delete' OR (op = 'update' AND status IS NOT NULL)"
        value = f"CASE WHEN {made} THEN 'active' WHEN op = 'soft_delete' THEN 'deleted' ELSE status END"
    else:
        full = f"coalesce({field}, {_default(field)})"
        partial = ["update"] + (["update_meta"] if field in META_FIELDS else []) + (["upsert"] if preserve_missing else [])
        always = ["update_plan"] if field == "plan" else []
        always += [] if preserve_missing else ["upsert"]
        writes = f"{made} OR ({field} IS NOT NULL AND op IN ({_quoted(partial)}))"
        if always:
            writes += f" OR op IN ({_quoted(always)})"
        untitled = "op = 'create'" if field == "title" else "false"
        resets = made if preserve_missing else f"({made} OR op = 'upsert')"
        value = f"CASE WHEN {resets} AND NOT ({untitled}) THEN {full} ELSE {field} END"
    return F.expr(f"max(IF({writes}, named_struct('seq', seq, 'v', {value}), NULL))")


def _quoted(ops) -> str:
    return ", ".join(f"'{op}'" for op in ops)


def assign_ids(requests: DataFrame) -> DataFrame:
    """A create without an id gets one made from its `seq`, the same on every run."""
    made = F.sha2(F.concat(F.lit("itinerary:"), F.col("seq").cast("string")), 256)
    kind = requests.schema["id"].dataType
    if kind.simpleString() != "string":
        return requests
    return requests.withColumn(
        "id", F.when((F.col("op") == "create") & F.col("id").isNull(), made).otherwise(F.col("id")))


def apply_itinerary_changes(snapshot: DataFrame, requests: DataFrame, as_of=None,
                            guest_policy: str = "documented", preserve_missing: bool = False,
                            chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply requests (seq unique, op, id, user_id, field columns, optional ts) to a snapshot, in
    the order of `seq`. Returns the new snapshot and the outcomes (seq, id, op, success,
    error_code). `as_of` stamps requests without a `ts` column; it defaults to the clock.

    `preserve_missing=False` is the published upsert: a field left out is reset to its default.
    `chunks` is the number of ranges of `seq`, as many as there are shuffle partitions by default."""
    for field in (*FIELDS, "status"):
        if field not in requests.columns:
            requests = requests.withColumn(field, F.lit(None).cast("string"))
    if "ts" not in requests.columns:
        requests = requests.withColumn("ts", F.lit(as_of) if as_of is not None else F.current_timestamp())
    requests = assign_ids(requests)
    chunks = chunks or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Without an id nothing can be found; such requests would all meet in one group.
    keyless = requests.filter("id IS NULL").withColumns({
        "present": F.lit(False), "owner": F.lit(None).cast(snapshot.schema["user_id"].dataType)})
    keyless_out = _with_outcome(keyless, guest_policy).withColumns({
        "error_code": F.when(F.col("op").isin("create", "upsert"), "id_is_null").otherwise(F.col("error_code")),
        "success": F.lit(False)})
    control = requests.filter("id IS NOT NULL").select("seq", "id", "op", "user_id")
    # Both results start from here.
    met = cut_lineage(_with_outcome(_with_state(control, snapshot, chunks), guest_policy).select(
        "seq", "id", "op", "user_id", "life", "last_life", "present", "owner", "success", "error_code"))
    columns = ("seq", "id", "op", "success", "error_code")
    outcomes = met.select(*columns).unionByName(keyless_out.select(*columns))

    effective = (F.col("error_code") == "ok") & (F.col("op") != "delete")
    # Only what counts for the final state fetches its fields again, by its own number.
    fields = requests.select("seq", "ts", *FIELDS, "status")
    current = met.filter(effective & (F.col("life") == F.col("last_life"))).join(fields, "seq")
    made = "NOT present AND op IN ('create', 'upsert')"
    aggregates = [
        F.expr("max(named_struct('seq', seq, 'ts', ts)).ts").alias("_ts"),
        F.expr(f"max(IF({made}, named_struct('seq', seq, 'ts', ts, 'user', user_id), NULL))").alias("_birth"),
        # The owner is named at birth, or else claimed; at most one claim of a life succeeds.
        F.expr("max(IF(op = 'claim', user_id, NULL))").alias("_claim_user"),
        *[_last_write(f, preserve_missing).alias(f"_w_{f}") for f in (*FIELDS, "status")],
    ]
    changes = current.groupBy("id").agg(*aggregates)

    ended = control.filter("op = 'delete'").select("id").distinct()
    kept = snapshot.select(*COLUMNS).join(ended, "id", "left_anti").withColumn("_had", F.lit(True))
    both = kept.join(changes, "id", "full")
    final = both.withColumn("_had", F.coalesce("_had", F.lit(False))).filter("_had OR _birth IS NOT NULL")
    out = {
        "created_at": "IF(_had, created_at, _birth.ts)",
        "updated_at": "coalesce(_ts, updated_at)",
        "user_id": "coalesce(IF(_had, user_id, _birth.user), _claim_user)",
        **{f: f"IF(_w_{f} IS NOT NULL, _w_{f}.v, {f})" for f in (*FIELDS, "status")},
    }
    return final.selectExpr("id", *[f"{out[c]} AS {c}" for c in COLUMNS if c != "id"]), outcomes
