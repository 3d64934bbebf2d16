"""Table changes as snapshots: (base, change batch) -> new DataFrame.

Parquet files are immutable and Spark has no UPDATE on them, so every change
of the reference (INSERT, UPDATE ... WHERE key, DELETE, replace-a-set, status
moves, upsert, cascades) is a join that produces the next snapshot, written
to a new directory by ``sources.snapshot.publish``. All joins are on the
table's key; "latest change per key" is a grouped ``max(struct(ts, id, ...))``
(partial aggregation), so a key that receives a third of all changes is
combined map-side instead of sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import APPLICATION_STATUSES, TABLES, children_of

HIT = "__hit"


def _one_per_key(rows: DataFrame, keys, order, pick) -> DataFrame:
    """One row per key: the first or last by ``order``, then by the other columns."""
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.distinct()
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values if c not in order])
    picked = rows.groupBy(*keys).agg(pick(packed).alias("__one"))
    return picked.select(*keys, *[F.col(f"__one.{c}").alias(c) for c in values])


def split_inserts(base: DataFrame, rows: DataFrame, keys, order=()) -> tuple[DataFrame, DataFrame]:
    """M1 with its refusals: (rows to append, refused rows with ``refused``).

    A row is refused if part of its key is missing, if ``base`` has the key, or if an
    earlier row of the batch (by ``order``, then by the other columns) has it.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    known = base.select(*keys).withColumn(HIT, F.lit(True))
    named = rows.where(whole).join(known, list(keys), "left")
    values = [c for c in rows.columns if c not in keys and c not in order]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *values, *keys))
    new = named.where(F.col(HIT).isNull()).withColumn("__turn", turn)
    first = new.where("__turn = 1").select(*rows.columns)
    later = new.where("__turn > 1").select(*rows.columns)
    refused = (rows.where(~whole).withColumn("refused", F.lit("key is missing"))
               .unionByName(named.where(F.col(HIT)).select(*rows.columns).withColumn("refused", F.lit("key exists")))
               .unionByName(later.withColumn("refused", F.lit("key appears earlier in the batch"))))
    return first, refused


def apply_inserts(base: DataFrame, rows: DataFrame, keys, order=()) -> DataFrame:
    """M1: the rows that ``split_inserts`` lets in are appended; keys stay unique."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    new = rows.where(whole).join(base.select(*keys), list(keys), "left_anti")
    first = _one_per_key(new.select(*dict.fromkeys([*base.columns, *order])), keys, list(order), F.min)
    return base.unionByName(first.select(*base.columns))


def latest_per_key(changes: DataFrame, keys, order) -> DataFrame:
    """The last change per key by ``order`` columns (ties: later columns)."""
    return _one_per_key(changes, keys, list(order), F.max)


def apply_updates(base: DataFrame, changes: DataFrame, keys, columns,
                  order=None) -> DataFrame:
    """M2: set ``columns`` of matching keys from the latest change.

    Each key gets one change, the last by ``order`` (without one, the largest values),
    so base rows never multiply. A change to NULL overwrites: the match is tested with a marker column,
    not with ``coalesce``. Keys missing from ``base`` are ignored (UPDATE).
    """
    ch = changes.select(*dict.fromkeys([*keys, *columns, *(order or [])]))
    ch = latest_per_key(ch, keys, order or [])
    ch = ch.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns],
                   F.lit(True).alias(HIT))
    j = base.join(ch, list(keys), "left")
    out = [F.when(F.col(HIT), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
           if c in columns else F.col(c) for c in base.columns]
    return j.select(*out)


def apply_deletes(base: DataFrame, doomed: DataFrame, keys) -> DataFrame:
    """M4: drop rows whose key is in ``doomed``."""
    return base.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def replace_set(base: DataFrame, new_sets: DataFrame, parent_keys, parents=None) -> DataFrame:
    """M5: for every parent its rows are replaced by its new set.

    ``new_sets`` holds one set per parent (of several edits, the one that M2 lets win);
    ``parents`` names parents whose new set may be empty.
    """
    named = (new_sets if parents is None else parents).select(*parent_keys).distinct()
    kept = base.join(named, list(parent_keys), "left_anti")
    return kept.unionByName(new_sets.select(*base.columns).distinct())


def soft_close(base: DataFrame, targets: DataFrame, keys, column: str, value: str) -> DataFrame:
    """M6: status move (Closed / Cancelled / Withdrawn); the row is kept."""
    ch = targets.select(*keys).distinct().withColumn(column, F.lit(value))
    return apply_updates(base, ch, keys, [column])


def upsert_partial(base: DataFrame, batch: DataFrame, keys, column: str, order=None) -> DataFrame:
    """M7: insert new keys; on a duplicate key update only ``column``.

    Of several rows with a new key the first by ``order`` is inserted and the last one's
    ``column`` then overwrites it, as if the rows came one by one.
    """
    order = list(order or [column])
    batch = batch.select(*dict.fromkeys([*base.columns, *order]))
    last = latest_per_key(batch, keys, order).select(*keys, column)
    grown = apply_inserts(base, batch, keys, order)
    return apply_updates(grown, last, keys, [column])


def scoped_status_update(application: DataFrame, job: DataFrame, changes: DataFrame,
                         statuses=APPLICATION_STATUSES) -> DataFrame:
    """M3: status changes applied only where the caller owns the job and the
    status is in the domain; the latest such change per application wins."""
    owner = (application.select("application_id", "job_id")
             .join(job.select("job_id", F.col("company_id").alias("owner_id")), "job_id"))
    valid = (changes.where(F.col("status").isin(*statuses))
             .join(owner, "application_id")
             .where(F.col("owner_id") == F.col("company_id"))
             .select("application_id", "status", "ts", "change_id"))
    return apply_updates(application, valid, ["application_id"], ["status"],
                         order=["ts", "change_id"])


def cascade_delete(tables: dict[str, DataFrame], parent: str, doomed: DataFrame
                   ) -> tuple[dict[str, DataFrame], DataFrame]:
    """M8: delete parent rows; RESTRICT children block, CASCADE children go.

    Returns (new snapshots of every changed table, blocked parent keys with
    the blocking table). The CASCADE children of this schema have no children
    of their own, so one level of cascade is complete here.
    """
    pk = list(TABLES[parent].primary_key)
    asked = doomed.select(*pk).distinct()
    blockers = []
    for child, fk in children_of(parent):
        if fk.on_delete != "RESTRICT":
            continue
        refs = (tables[child].select(*[F.col(c).alias(p) for c, p in
                                       zip(fk.columns, fk.parent_columns)])
                .join(asked, pk, "left_semi").distinct()
                .withColumn("blocked_by", F.lit(child)))
        blockers.append(refs)
    blocked = (reduce(DataFrame.unionByName, blockers) if blockers
               else asked.where(F.lit(False)).withColumn("blocked_by", F.lit("")))
    gone = asked.join(blocked.select(*pk), pk, "left_anti")
    out = {parent: apply_deletes(tables[parent], gone, pk)}
    for child, fk in children_of(parent):
        if fk.on_delete != "CASCADE":
            continue
        child_gone = (tables[child]
                      .join(gone.select(*[F.col(p).alias(c) for c, p in
                                          zip(fk.columns, fk.parent_columns)]),
                            list(fk.columns), "left_semi")
                      .select(*TABLES[child].primary_key))
        out[child] = apply_deletes(tables[child], child_gone, list(TABLES[child].primary_key))
    return out, blocked


def cascade_key_update(tables: dict[str, DataFrame], parent: str, key_map: DataFrame
                       ) -> dict[str, DataFrame]:
    """ON UPDATE CASCADE — a renamed parent key flows to every child.

    ``key_map`` has ``old`` and ``new`` for a single-column key.
    """
    (pk,) = TABLES[parent].primary_key
    m = key_map.select("old", "new")

    def renamed(df: DataFrame, col: str) -> DataFrame:
        j = df.join(m.withColumnRenamed("old", col), col, "left")
        return j.select(*[F.coalesce(F.col("new"), F.col(col)).alias(col) if c == col
                          else F.col(c) for c in df.columns])

    out = {parent: renamed(tables[parent], pk)}
    for child, fk in children_of(parent):
        out[child] = renamed(tables[child], fk.columns[0])
    return out
