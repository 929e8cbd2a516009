"""Mixing sources to target weights: a Pfair timetable of source blocks.

Every source is cut into blocks of ``block_docs`` documents (the last may be
shorter). A source with share q/D of the mixture gives its k-th block the
release time floor((k-1) D / q) and the deadline ceil(k D / q); in every slot the
released block with the earliest deadline goes next. As the shares add up to
one, all deadlines are met and after any number of slots each source is less
than one block away from its target. The timetable repeats after D slots, so
only D slots are ever simulated, however many blocks there are.

Weights are exact: a given weight is taken as the decimal number it is written as, and
D is the sum of the weights in whole units of their last place. Weights that need a
longer period than ``MOST_SLOTS`` are refused, not rounded.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: The longest period that is simulated.
MOST_SLOTS = 200_000
_PLACES = 18
#: Slots simulated between two additions to the timetable.
_STRIDE = 512

_PICK = """
array_min(filter(
  transform(quotas, (q, i) -> if(q > 0 and (now.used[i] * period) div q <= t,
                                 named_struct('due', ((now.used[i] + 1) * period + q - 1) div q, 'i', i),
                                 null)),
  d -> d is not null)).i
"""
_TIMETABLE = f"""
aggregate(
  sequence(0L, (period - 1) div {_STRIDE}),
  named_struct('used', transform(quotas, q -> 0L), 'slots', cast(array() as array<int>)),
  (all, w) -> transform(array(aggregate(
      sequence(w * {_STRIDE}, least(w * {_STRIDE} + {_STRIDE}, period) - 1),
      named_struct('used', all.used, 'slots', cast(array() as array<int>)),
      (now, t) -> transform(array({_PICK}),
        pick -> named_struct('used', transform(now.used, (u, i) -> u + if(i = pick, 1L, 0L)),
                             'slots', concat(now.slots, array(pick))))[0])),
    part -> named_struct('used', part.used, 'slots', concat(all.slots, part.slots)))[0],
  all -> all.slots)
"""


def default_quotas(docs: DataFrame, quanta: int = 1000) -> DataFrame:
    """source and quota if no weights are given: the default mixture, in thousandths.

    By the whole part of the square root of a source's rows, and one thousandth at
    least. The quotas are the weights, so nothing is rounded after this.
    """
    counts = docs.groupBy("source").agg(F.floor(F.sqrt(F.count(F.lit(1)))).cast("double").alias("w"))
    share = F.floor(F.lit(quanta) * F.col("w") / F.sum("w").over(Window.partitionBy()) + 0.5)
    return counts.select("source", F.greatest(share, F.lit(1)).alias("quota"))


def target_quotas(docs: DataFrame, weights: DataFrame, most_slots: int = MOST_SLOTS) -> DataFrame:
    """source and quota: its slots in one period; the period is the sum of quotas.

    ``weights`` has (source, weight), one row a source. A source with a zero, negative,
    null or no weight has quota 0. Weights are decimals of up to 18 places; what takes
    more than ``most_slots`` slots to meet exactly raises ValueError (whole numbers, such
    as 1, 1 and 1 for thirds, need the fewest).
    """
    whole = F.col("weight").cast(f"decimal(38,{_PLACES})")
    given = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("w"), whole.alias("d"))
    if given.where("w > 0 AND (d IS NULL OR d = 0)").limit(1).count():
        raise ValueError(f"a weight needs more than {_PLACES} decimal places")
    digits = F.regexp_replace(F.col("d").cast("string"), "0+$", "")
    used = given.where("d > 0").agg(
        F.max(F.char_length(digits) - F.instr(digits, F.lit("."))).alias("places"), F.sum("d").alias("total")).first()
    places = used["places"] or 0
    if used["total"] is not None and used["total"] * 10 ** places > most_slots:
        raise ValueError(f"the weights need {used['total'] * 10 ** places:.0f} slots a period; "
                         f"{most_slots} are allowed: round them to fewer places")
    quota = F.greatest(F.coalesce(F.col("d") * F.lit(10 ** places), F.lit(0)), F.lit(0)).cast("long")
    return docs.select("source").distinct().join(
        given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", quota.alias("quota"))


def timetable(quotas: DataFrame) -> DataFrame:
    """source, quota, period, nth (from 0), phase: the slot of its nth block in a period."""
    one = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("_all")).select(
        F.transform("_all", lambda x: x["source"]).alias("sources"),
        F.transform("_all", lambda x: x["quota"].cast("long")).alias("quotas"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x["quota"]).alias("period"))
    slots = one.where("period > 0").select(
        "sources", "quotas", "period", F.posexplode(F.expr(_TIMETABLE)).alias("phase", "_i"))
    order = Window.partitionBy("_i").orderBy("phase")
    return slots.select(
        F.get("sources", F.col("_i")).alias("source"), F.get("quotas", F.col("_i")).alias("quota"),
        "period", (F.row_number().over(order) - 1).cast("long").alias("nth"),
        F.col("phase").cast("long").alias("phase"))


def _numbered(rows: DataFrame, n_docs: int, own: list[str]) -> DataFrame:
    """``rows`` (source, id, key and ``own``) with place: its number within its source, from 0.

    Rows are numbered in small hash buckets, whatever the source's size, and bucket
    offsets come from counts alone.
    """
    buckets = max(1, -(-n_docs // 256))
    bucket = F.floor((F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets)) / F.lit(1 << 32))
    keyed = rows.withColumn("bucket", bucket.cast("long"))
    counts = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "stretch", F.floor(F.col("bucket") / 256))
    before = Window.unboundedPreceding, -1
    inner = Window.partitionBy("source", "stretch").orderBy("bucket").rowsBetween(*before)
    outer = Window.partitionBy("source").orderBy("stretch").rowsBetween(*before)
    stretches = counts.groupBy("source", "stretch").agg(F.sum("n").alias("m")).select(
        F.col("source").alias("s"), F.col("stretch").alias("g"),
        F.coalesce(F.sum("m").over(outer), F.lit(0)).alias("earlier"))
    offsets = counts.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(
        stretches, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("g"))).select(
        F.col("source").alias("s2"), F.col("bucket").alias("b2"),
        (F.col("earlier") + F.col("inside")).alias("offset"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "id")
    return keyed.withColumn("row", F.row_number().over(order) - 1).join(
        offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).select(
        *own, "source", (F.col("offset") + F.col("row")).alias("place"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = 16,
                most_slots: int = MOST_SLOTS) -> DataFrame:
    """All columns of ``docs`` with block, slot, target_weight and mix_order.

    Needs doc_id and source. Sorting by mix_order gives the mixture. A source's
    documents are taken in the order of md5(doc_id), or md5 of the text where the id is
    null. No row is dropped or repeated: a source that runs out leaves its later slots
    empty, and the others keep their places. Sources of weight zero (see
    ``target_quotas``) come after the mixture, one after the other. A null source is a
    source of its own; rows with equal doc_id share its place in the order and take
    neighbouring places in any order; an empty table gives no rows. Own columns of the
    four added names are replaced; any other name is safe.
    """
    added = ("block", "slot", "target_weight", "mix_order")
    names = [c for c in docs.columns if c not in added]
    quotas = default_quotas(docs) if weights is None else target_quotas(docs, weights, most_slots)
    table_of = timetable(quotas)
    spare = F.coalesce("text", F.lit("")) if "text" in names else F.lit("")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), spare).cast("binary"))
    # Own columns travel under numbers, so that no name can clash and unused ones are left out.
    own = [f"own_{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)],
                       "source", F.col("doc_id").alias("id"), key.alias("key"))
    blocked = _numbered(rows, docs.count(), own).withColumn("block", F.floor(F.col("place") / block_docs))

    # One row a source: its quota, and for those of weight zero the slot of their first block.
    blocks = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block_docs).alias("blocks"))
    sized = blocks.join(quotas.select(F.col("source").alias("s"), "quota"), F.col("source").eqNullSafe(F.col("s")))
    everything = Window.partitionBy()
    period = F.sum("quota").over(everything)
    end = F.max(F.when(F.col("quota") > 0, F.ceil(F.col("blocks") / F.col("quota")) * period)).over(everything)
    unweighted = F.when(F.col("quota") == 0, F.col("blocks"))
    earlier = Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sources = sized.select(
        F.col("source").alias("s4"), F.col("quota").alias("q"), period.alias("period"),
        (F.coalesce(end, F.lit(0)) + F.coalesce(F.sum(unweighted).over(earlier), F.lit(0))).alias("tail"))
    slots = table_of.select(F.col("source").alias("s3"), "nth", "phase")
    placed = blocked.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s4"))).join(
        F.broadcast(slots), F.col("source").eqNullSafe(F.col("s3"))
        & (F.col("nth") == F.col("block") % F.nullif("q", F.lit(0))), "left")
    mixed = F.floor(F.col("block") / F.nullif("q", F.lit(0))) * F.col("period") + F.col("phase")
    slot = F.when(F.col("q") > 0, mixed).otherwise(F.col("tail") + F.col("block"))
    return placed.select(
        *[F.col(o).alias(c) for c, o in zip(names, own)], "block", slot.alias("slot"),
        F.coalesce(F.col("q") / F.nullif("period", F.lit(0)), F.lit(0.0)).alias("target_weight"),
        (slot * block_docs + F.col("place") % block_docs).alias("mix_order"))


MIX_SQL = """
WITH RECURSIVE counts AS (SELECT source, floor(sqrt(count(*))) AS w FROM {docs} GROUP BY source),
quotas AS (
  SELECT source, greatest(1, floor(1000 * w / sum(w) OVER () + 0.5))::BIGINT AS quota FROM counts),
one AS (
  SELECT list(source ORDER BY source NULLS FIRST) AS sources,
         list(quota ORDER BY source NULLS FIRST) AS quotas, sum(quota)::BIGINT AS period
  FROM quotas),
tick(t, pick, used) AS (
  SELECT -1::BIGINT, NULL::BIGINT, list_transform(quotas, lambda q: 0::BIGINT) FROM one
  UNION ALL
  SELECT t + 1, chosen,
         list_transform(range(1, len(used) + 1), lambda i: used[i] + (i = chosen)::BIGINT)
  FROM (
    SELECT t, used, list_min(list_transform(range(1, len(quotas) + 1), lambda i:
             CASE WHEN (used[i] * period) // quotas[i] <= t + 1
                  THEN {{'due': ((used[i] + 1) * period + quotas[i] - 1) // quotas[i], 'i': i}} END)).i AS chosen
    FROM tick, one WHERE t + 1 < period)),
timetable AS (
  SELECT sources[pick] AS source, quotas[pick] AS quota, period, t AS phase,
         row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth
  FROM tick, one WHERE t >= 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source
           ORDER BY md5(coalesce(doc_id::VARCHAR, text, '')), doc_id) - 1 AS place FROM {docs}),
blocked AS (
  SELECT p.*, place // 16 AS block, q.quota AS q
  FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source),
mixed AS (
  SELECT b.*, (block // q) * period + phase AS slot, t.quota / t.period AS target_weight,
         ((block // q) * period + phase) * 16 + place % 16 AS mix_order
  FROM blocked b JOIN timetable t
    ON b.source IS NOT DISTINCT FROM t.source AND t.nth = b.block % b.q)
"""
