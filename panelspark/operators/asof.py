"""As-of lookups: the latest earlier observation of an entity, with nearest neighbours as fallback.

The own-history tier is a merge of targets and observations, ordered by date: the last observation
seen so far is carried along. So that a very frequent entity isn't one task, its rows are dealt by
(entity, period), each period is merged alone, and a target that finds nothing in its period takes
the last observation of the latest earlier period (one row per entity and period).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import haversine_atan2
from ..held import hold
from .nearby import around

TIE_KM = 1e-9


def latest(targets: DataFrame, observations: DataFrame, by: list[str], bound: str, date: str, value: Column, inclusive: bool = False, period: str = "year") -> DataFrame:
    """``targets`` with ``found``: the ``value`` (a struct that begins with the date) of the latest observation before ``bound``.

    ``inclusive`` also admits an observation at the bound. Of equal dates the greatest value is taken. Null if
    there is none; observations with a null key or date are no one's, and targets with a null key find none.
    """
    at = F.col(bound).cast("timestamp")
    t = targets.select(*by, at.alias("__at"), F.lit(0 if not inclusive else 1).alias("__side"), F.struct("*").alias("__t"), F.lit(None).cast(observations.select(value.alias("v")).schema["v"].dataType).alias("__v"))
    o = observations.dropna(subset=[*by, date]).select(*by, F.col(date).cast("timestamp").alias("__at"), F.lit(1 - (0 if not inclusive else 1)).alias("__side"), F.lit(None).cast(t.schema["__t"].dataType).alias("__t"), value.alias("__v"))
    both = t.unionByName(o).withColumn("__period", F.date_trunc(period, "__at"))
    seen = Window.partitionBy(*by, "__period").orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("__own", F.last("__v", ignorenulls=True).over(seen)).filter("__t IS NOT NULL")
    ends = o.withColumn("__period", F.date_trunc(period, "__at")).groupBy(*by, "__period").agg(F.max(F.struct("__at", "__v")).alias("__last"))
    # periods of targets and observations alike, one row each: the last value of any earlier period; targets give theirs before the merge, which isn't worked out twice
    periods = t.select(*by, F.date_trunc(period, "__at").alias("__period")).distinct().withColumn("__last", F.lit(None).cast(ends.schema["__last"].dataType)).unionByName(ends)
    per = periods.groupBy(*by, "__period").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy(*by).orderBy("__period").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.withColumn("__before", F.last("__last", ignorenulls=True).over(earlier)["__v"]).select(*by, "__period", "__before")
    done = merged.join(carried, [*by, "__period"], "left")
    return done.select("__t.*", F.coalesce("__own", "__before").alias("found"))


def with_fallback(targets: DataFrame, observations: DataFrame, entity: str, date: str, group: str, lat: str, lon: str, value: str, lag_months: int = 0) -> DataFrame:
    """Persistence: adds ``source`` (own, group, global or null), ``source_entity``, ``source_date`` and ``source_value``.

    An observation qualifies if its date is at most ``lag_months`` months before the target's (inclusive), or
    strictly before it for lag 0. Own history comes first; else the latest date on which any entity of the
    group was observed, and of those observed then the nearest (ties within TIE_KM: the least id); else the same
    over all entities. Places that are missing come last: where no distance is known, the least id is taken.
    Every target comes back, repeated ones as often as they are; a null group has no group tier, a null date no source.

    Both tables are read several times: one that is worked out is to be held (``held.hold``) by the caller.
    Targets without history are reduced to distinct questions (group, latest date, place), which meet the observations of
    that date in the leaves around them only.
    """
    inclusive = lag_months > 0
    obs = observations.select(entity, date, group, lat, lon, value)
    t = targets.withColumn("__bound", F.add_months(date, -lag_months) if lag_months else F.col(date))
    seen = F.struct(F.col(date).alias("d"), F.col(entity).alias("e"), F.col(value).alias("v"))
    own = hold(latest(t, obs, [entity], "__bound", date, seen, inclusive).withColumn("source", F.when(F.col("found").isNotNull(), "own")))
    kind = own.schema["found"].dataType
    done, rest = [own.filter("found IS NOT NULL")], own.filter("found IS NULL").drop("found", "source")
    for tier, scope in (("group", F.col(group)), ("global", F.lit(1))):
        asked = rest.select(scope.alias("__key"), "__bound", F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).filter("__key IS NOT NULL").distinct()
        marked = obs.filter(F.col(date).isNotNull()).select(scope.alias("__key"), date, F.struct(F.col(entity).alias("e"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(value).alias("v")).alias("c"))
        last = latest(asked.select("__key", "__bound").distinct(), marked.select("__key", date).distinct(), ["__key"], "__bound", date, F.struct(F.col(date).alias("d")), inclusive)
        last = last.filter("found IS NOT NULL").select("__key", "__bound", F.col("found.d").alias("__date"))
        last = hold(last)
        places = hold(asked.join(last, ["__key", "__bound"]).select("__key", "__date", "__lat", "__lon").distinct())
        by = ["__key", "__date"]
        near = marked.withColumnRenamed(date, "__date").join(places.select(*by).distinct(), by, "left_semi")
        at = near.groupBy(*by, F.col("c.lat").alias("__lat"), F.col("c.lon").alias("__lon")).agg(F.min("c").alias("point"))
        pairs = around(places, at, by, "__lat", "__lon", 1).withColumn("__km", haversine_atan2(F.col("__lat"), F.col("__lon"), F.col("point.lat"), F.col("point.lon")))
        question = [*by, "__lat", "__lon"]
        least = F.min("__km").over(Window.partitionBy(*question))
        close = pairs.withColumn("__least", least).filter(F.col("__km") <= F.col("__least") + TIE_KM).groupBy(*question).agg(F.min("point").alias("c"))
        same_place = F.col("q.__lat").eqNullSafe(F.col("n.__lat")) & F.col("q.__lon").eqNullSafe(F.col("n.__lon")) & (F.col("q.__key") == F.col("n.__key")) & (F.col("q.__date") == F.col("n.__date"))
        any_of = near.groupBy(*by).agg(F.min("c").alias("__any"))
        answers = places.alias("q").join(close.alias("n"), same_place, "left").select("q.*", "n.c").join(any_of, by).select(*question, F.coalesce("c", "__any").alias("c"))
        answers = answers.join(last, by).select("__key", "__bound", F.col("__lat").alias("__qlat"), F.col("__lon").alias("__qlon"), F.struct(F.col("__date").alias("d"), F.col("c.e").alias("e"), F.col("c.v").alias("v")).alias("found"))
        keyed = rest.withColumn("__k", scope).withColumnRenamed("__bound", "__b")
        on = (F.col("__k") == F.col("__key")) & (F.col("__b") == F.col("__bound")) & F.col(lat).eqNullSafe(F.col("__qlat")) & F.col(lon).eqNullSafe(F.col("__qlon"))
        met = hold(keyed.join(answers, on, "left").drop("__k", "__key", "__bound", "__qlat", "__qlon").withColumnRenamed("__b", "__bound"))
        done.append(met.filter("found IS NOT NULL").withColumn("source", F.lit(tier)))
        rest = met.filter("found IS NULL").drop("found")
    done.append(rest.withColumns({"found": F.lit(None).cast(kind), "source": F.lit(None).cast("string")}))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*targets.columns, "source", F.col("found.e").alias("source_entity"), F.col("found.d").alias("source_date"), F.col("found.v").alias("source_value"))
