"""Keeping the documents table in step with a file set.

The built-in catalog has no MERGE/UPDATE/DELETE, and a snapshot cannot be
overwritten while it is read, so every mutation is a pure function
``(state, changes) -> next_state``; callers write the result to a new snapshot
folder (``sources.files.write_snapshot``).  All joins are on the document key
``(repository, context, filepath)``; scopes are ``(repository, context)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ids import assign_dense_ids
from quarry.plans.guards import guarded_broadcast
from quarry.schemas import DOCUMENT_KEY

KEY = list(DOCUMENT_KEY)
SCOPE = ["repository", "context"]

FRESH, UPDATE, INSERT, SKIP, PRUNE, KEEP = "fresh", "update", "insert", "skip", "prune", "keep"


#: Scopes up to which their list is broadcast.
MAX_SCOPES = 100_000


def _scopes(incoming: DataFrame, scopes: DataFrame | None) -> DataFrame:
    """The loaded scopes, broadcast when counted to be few: joining the state to them must
    not deal it by scope, of which one may hold a third of all rows."""
    distinct = (scopes if scopes is not None else incoming).select(*SCOPE).distinct()
    return guarded_broadcast(distinct.withColumn("__in_scope", F.lit(True)), MAX_SCOPES)


def classify(
    state: DataFrame,
    incoming: DataFrame,
    *,
    scopes: DataFrame | None = None,
    key: Sequence[str] = KEY,
    updated_col: str = "updated_at",
    modified_col: str = "modified_at",
    content_col: str = "content",
    keep_content: bool = True,
) -> DataFrame:
    """One row per key of either side with its class (C2):

    * both sides: ``fresh`` when stored ``updated_at`` is strictly after the file's
      ``modified_at``; else ``skip`` for empty content, else ``update``
      (freshness is tested before emptiness);
    * file only: ``skip`` for empty content, else ``insert``;
    * stored only: ``prune`` when its scope is being loaded, else ``keep``.

    ``scopes`` defaults to the scopes present in ``incoming``; pass it explicitly
    to prune a scope whose file list is empty.  With ``keep_content=False`` only
    the content length travels through the join (file texts are not shuffled);
    ``changed_content`` fetches the text of the rows that need it afterwards.
    """
    key = list(key)
    s = state.select(*key, "id", F.col(updated_col).alias("updated_at"), F.lit(True).alias("__s"))
    payload = F.col(content_col).alias("content") if keep_content else \
        F.length(F.col(content_col)).alias("content_length")
    i = incoming.select(*key, F.col(modified_col).alias("modified_at"), payload, F.lit(True).alias("__i"))
    j = s.join(i, key, "full_outer").join(_scopes(incoming, scopes), SCOPE, "left")
    n_chars = F.length("content") if keep_content else F.col("content_length")
    empty = F.coalesce(n_chars, F.lit(0)) == 0
    cls = (
        F.when(F.col("__i").isNull(), F.when(F.col("__in_scope"), F.lit(PRUNE)).otherwise(F.lit(KEEP)))
        .when(F.col("__s").isNull(), F.when(empty, F.lit(SKIP)).otherwise(F.lit(INSERT)))
        .when(F.col("updated_at") > F.col("modified_at"), F.lit(FRESH))
        .when(empty, F.lit(SKIP))
        .otherwise(F.lit(UPDATE))
    )
    return j.select(*key, "id", "updated_at", "modified_at", "content" if keep_content else "content_length",
                    cls.alias("class"))


def changed_content(classes: DataFrame, incoming: DataFrame, *, key: Sequence[str] = KEY,
                    content_col: str = "content") -> DataFrame:
    """Insert/update rows of a ``classify(keep_content=False)`` result with their
    text, read from ``incoming`` only for those keys (a small change set is
    broadcast by AQE, so unchanged texts are never shuffled)."""
    key = list(key)
    ch = classes.filter(F.col("class").isin(INSERT, UPDATE)).select(*key, "modified_at", "class")
    return ch.join(incoming.select(*key, F.col(content_col).alias("content")), key)


def prune(state: DataFrame, incoming: DataFrame, *, scopes: DataFrame | None = None,
          key: Sequence[str] = KEY) -> DataFrame:
    """Drop stored rows of a loaded scope whose path is not in the file set.
    Other scopes are untouched.  The file list is never collected."""
    key = list(key)
    present = incoming.select(*key).distinct().withColumn("__present", F.lit(True))
    j = state.join(present, key, "left").join(_scopes(incoming, scopes), SCOPE, "left")
    keep = F.col("__present").isNotNull() | F.col("__in_scope").isNull()
    return j.filter(keep).select(*state.columns)


def refresh(state: DataFrame, repository: str) -> DataFrame:
    """Delete every row of one repository, all contexts."""
    return state.filter(F.col("repository") != F.lit(repository))


def latest_per_key(changes: DataFrame, order_cols: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """One change per key, the greatest ``order_cols`` winning (remaining columns
    break ties).  A struct max is a partial aggregate, so a hot key is combined
    map side instead of landing in one window partition."""
    key = list(key)
    rest = [c for c in changes.columns if c not in key]
    ordered = list(order_cols) + [c for c in rest if c not in order_cols]
    agg = changes.groupBy(*key).agg(F.max(F.struct(*[F.col(c) for c in ordered])).alias("__w"))
    return agg.select(*key, *[F.col("__w")[c].alias(c) for c in rest])


def _new_ids(rows: DataFrame, state: DataFrame, key: Sequence[str], start_after: Column | None = None) -> DataFrame:
    start = F.coalesce(state.select(F.max("id")).scalar(), F.lit(0))
    if start_after is not None:
        start = F.greatest(start, F.coalesce(start_after, F.lit(0)))
    return assign_dense_ids(rows, key, start)


def upsert(
    state: DataFrame,
    changes: DataFrame,
    *,
    key: Sequence[str] = KEY,
    on_conflict: str = "update",
    set_cols: Mapping[str, Column] | None = None,
    order_cols: Sequence[str] = ("updated_at",),
    start_after: Column | None = None,
) -> DataFrame:
    """Insert ``changes`` into ``state`` keyed by ``key``.

    * ``on_conflict="update"``: new values win, the stored id is kept (C4);
    * ``on_conflict="ignore"``: stored rows win, only new keys are added (C5);
    * ``on_conflict="custom"``: ``set_cols`` maps a column to an expression over
      ``old.<col>`` / ``new.<col>``; unlisted columns keep the old value (C6).

    Duplicate keys inside ``changes`` are reduced to the latest first.  New keys
    get dense ids after ``max(state.id)`` (or after ``start_after`` when larger,
    e.g. the maximum id before a prune: ids are never reused).
    """
    key = list(key)
    if on_conflict not in ("update", "ignore", "custom"):
        raise ValueError(f"unknown on_conflict {on_conflict!r}")
    cols = [c for c in state.columns if c != "id"]
    ch = latest_per_key(changes.select(*key, *[c for c in cols if c not in key and c in changes.columns]),
                        order_cols, key)
    # Ids of the keys that are not stored yet, from keys alone; then one full outer
    # join carries the payload of either side once.
    keys = changes.select(*key).distinct().join(state.select(*key), key, "left_anti")
    ids = _new_ids(keys, state, key, start_after).withColumnRenamed("id", "__id")
    new = ch.join(ids, key, "left").withColumn("__new", F.lit(True)).alias("new")
    old = state.withColumn("__old", F.lit(True)).alias("old")
    j = old.join(new, key, "full_outer")
    stored, changed = F.col("old.__old").isNotNull(), F.col("new.__new").isNotNull()
    types = dict(state.dtypes)
    out = []
    for c in cols:
        if c in key:
            out.append(F.col(c))
            continue
        had = F.col(f"old.{c}")
        came = F.col(f"new.{c}") if c in ch.columns else F.lit(None).cast(types[c])
        if c not in ch.columns or on_conflict == "ignore":
            val = had
        elif on_conflict == "update":
            val = came
        else:
            val = (set_cols or {}).get(c, had)
        out.append(F.when(~stored, came).when(changed, val).otherwise(had).alias(c))
    return j.select(F.coalesce(F.col("old.id"), F.col("new.__id")).alias("id"), *out).select(*state.columns)


def key_violations(state: DataFrame, changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys that would appear more than once after a plain insert."""
    key = list(key)
    both = state.select(*key).unionByName(changes.select(*key))
    return both.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def insert_checked(state: DataFrame, changes: DataFrame, *, required: Sequence[str],
                   key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Plain insert with the reference's checks (C7): rows missing a required
    field or violating the unique key are rejected (returned with a reason),
    the rest are appended with new ids.  A rejected row takes no part in the key
    check; of valid rows that share a key all are rejected.  Returns
    ``(next_state, rejected)``."""
    key = list(key)
    missing = F.lit(False)
    for c in required:
        t = F.col(c).isNull() | ((F.length(F.col(c)) == 0) if dict(changes.dtypes)[c] == "string" else F.lit(False))
        missing = missing | t
    # only rows that pass the field check can collide
    valid = changes.filter(~missing)
    dup = key_violations(state, valid, key).select(*key, F.lit(True).alias("__dup"))
    tagged = changes.withColumn("__missing", missing).join(dup, key, "left").withColumn(
        "reason",
        F.when(F.col("__missing"), F.lit("missing required field"))
        .when(F.col("__dup"), F.lit("unique key violation")),
    ).drop("__dup", "__missing")
    ok = tagged.filter(F.col("reason").isNull()).drop("reason")
    nxt = upsert(state, ok, key=key, on_conflict="ignore", order_cols=())
    return nxt, tagged.filter(F.col("reason").isNotNull())


def update_where(state: DataFrame, pred: Column, sets: Mapping[str, Column]) -> DataFrame:
    """``UPDATE .. SET .. WHERE pred`` as one projection over the original row (C8):
    the predicate and the new values see no column already set."""
    hit = F.coalesce(pred, F.lit(False))
    return state.select(*[F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in state.columns])


def affected(state: DataFrame, pred: Column) -> DataFrame:
    """Number of rows a predicate touches (C8/C9 return value), as a one-row frame."""
    return state.filter(pred).agg(F.count("*").alias("affected"))


def delete_where(state: DataFrame, pred: Column) -> DataFrame:
    """``DELETE .. WHERE pred`` (C9); rows where pred is null are kept, as in SQL."""
    return state.filter(~F.coalesce(pred, F.lit(False)))
