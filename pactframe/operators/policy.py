"""Policy packs: their rules, and which were in force when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactframe.functions.columns import instant
from pactframe.operators.asof import asof_lookup, running_sum
from pactframe.operators.tenancy import own_or_global
from pactframe.sources.tables import stored

# Fixed value: the jurisdiction of packs that apply everywhere.
EVERYWHERE = "ANY"


def policy_rules(packs: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """One row per rule of a pack; ``rules`` is a JSON array text or an array."""
    rows = packs if scope is None else own_or_global(packs, scope)
    rules = F.col("rules")
    if dict(packs.dtypes)["rules"] == "string":
        rules = F.from_json(rules, "array<string>")
    keep = [c for c in packs.columns if c != "rules"]
    return rows.select(*keep, F.posexplode(rules).alias("rule_ix", "rule"))


def _in_force(at: Column) -> Column:
    return F.col("active") & (F.col("effective_from") <= at) & (
        F.col("effective_to").isNull() | (F.col("effective_to") > at)
    )


def policy_packs_at(packs: DataFrame, at, jurisdiction: str | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Packs in force at one instant; the end of validity is exclusive."""
    rows = packs if scope is None else own_or_global(packs, scope)
    rows = rows.filter(_in_force(instant(at)))
    if jurisdiction is not None:
        rows = rows.filter(F.col("jurisdiction").isin(jurisdiction, EVERYWHERE))
    return rows


def pack_number(pack_id: Column) -> Column:
    """36 bits of the hash of a pack id, whose sum tells two pack sets apart and fits a long for 100 million packs."""
    return F.conv(F.substring(F.md5(pack_id.cast("string")), 1, 9), 16, 10).cast("long")


def _valid(packs: DataFrame) -> DataFrame:
    """Packs that are in force at some time, with their owner."""
    return packs.filter(
        F.col("active")
        & F.col("effective_from").isNotNull()
        & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("effective_from")))
    ).withColumn("owner", owner_of(F.col("account_id")))


def _changes(packs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(owner, jurisdiction, at, values): each pack adds its values where it begins and takes them back where it ends."""
    valid = _valid(packs).select("owner", "jurisdiction", "effective_from", "effective_to", *[v.alias(f"_{n}") for n, v in values.items()])
    changes = F.array(
        F.struct(F.col("effective_from").alias("at"), *[F.col(f"_{n}").alias(n) for n in values]),
        F.struct(F.col("effective_to").alias("at"), *[(-F.col(f"_{n}")).alias(n) for n in values]),
    )
    return valid.select("owner", "jurisdiction", F.inline(changes)).filter(F.col("at").isNotNull())


def _wide(asked: DataFrame, key: list[str]) -> DataFrame:
    """The rows once for each time line they ask: global and own, of their jurisdiction and of everywhere."""
    own = owner_of(F.col("account_id"))
    places = F.array(*[
        F.struct(owner.alias("owner"), where.alias("_where"))
        for owner in (F.lit("*"), own) for where in (F.col("jurisdiction"), F.lit(EVERYWHERE))
    ])
    # an analysis of everywhere, or of no account, asks for some lines twice
    return asked.select(*key, F.inline(F.array_distinct(places)))


def pack_timeline(packs: DataFrame) -> DataFrame:
    """Number of packs in force, and the sum of their numbers, after every change.

    One time line per (owner, jurisdiction); global packs have the owner ``*``,
    and a pack that applies everywhere has a time line of its own.
    """
    steps = _changes(packs, {"packs": F.lit(1), "pack_ids": pack_number(F.col("id"))})
    return running_sum(steps, ["owner", "jurisdiction"], "at", ["packs", "pack_ids"])


# ---- the bridge between analyses and packs -----------------------------------

FOREVER = "9999-01-01 00:00:00"
BLOCK = 128  # places of a time line whose sets are kept in one row


def set_timeline(packs: DataFrame) -> DataFrame:
    """(owner, jurisdiction, at, set_id): the set of packs in force after every change; NULL for none.

    A set is named by its content: its size and two sums of hashes of its pack
    ids, which follow from the differences at each change, so equal sets of any
    owner, jurisdiction and time have one name.
    """
    second = F.conv(F.substring(F.md5(F.col("id").cast("string")), 10, 9), 16, 10).cast("long")
    steps = _changes(packs.withColumn("_second", second), {"packs": F.lit(1), "one": pack_number(F.col("id")), "two": F.col("_second")})
    line = running_sum(steps, ["owner", "jurisdiction"], "at", ["packs", "one", "two"])
    return line.select("owner", "jurisdiction", "at", F.when(F.col("packs") > 0, F.concat_ws(":", "packs", "one", "two")).alias("set_id"))


def analysis_pack_sets(analyses: DataFrame, packs: DataFrame, at: str) -> DataFrame:
    """The distinct (account_id, jurisdiction, <at>) of the analyses with the ids of the pack sets that graded them.

    One row per set that is not empty, so up to four: of global and of own
    packs, for the jurisdiction and for everywhere.  The packs of an analysis
    are those of its sets in ``pack_sets``.
    """
    key = ["account_id", "jurisdiction", at]
    wide = _asked(analyses, packs, at)
    found = _sets_at(wide, packs, at).select("owner", F.col("jurisdiction").alias("_where"), F.col("_asked").alias(at), "set_id")
    return wide.join(found, ["owner", "_where", at]).select(*key, "set_id").distinct()


def used_pack_sets(analyses: DataFrame, packs: DataFrame, at: str) -> DataFrame:
    """The distinct set_id of ``analysis_pack_sets``, without a row per analysis."""
    return _sets_at(_asked(analyses, packs, at), packs, at).select("set_id").distinct()


def _asked(analyses: DataFrame, packs: DataFrame, at: str) -> DataFrame:
    """What the analyses ask of the time lines, as far as there are any."""
    key = ["account_id", "jurisdiction", at]
    lines = _valid(packs).select("owner", F.col("jurisdiction").alias("_where")).distinct()
    return _wide(analyses.select(*key).distinct(), key).join(lines, ["owner", "_where"], "left_semi")


def _sets_at(wide: DataFrame, packs: DataFrame, at: str) -> DataFrame:
    asks = wide.select("owner", F.col("_where").alias("jurisdiction"), F.col(at).alias("_asked"))
    return asof_lookup(asks, set_timeline(packs), ["owner", "jurisdiction"], "_asked", "at", ["set_id"]).where("set_id is not null")


def pack_sets(packs: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(set_id, pack_id): the dictionary of distinct pack sets, of those in ``used`` (set_id) if given.

    Each set is listed once, from the first place it is in force.  Places of a
    time line are numbered, and each pack is in a run of them, whose ends are
    looked up; so the work grows with the members listed, and no pack is
    compared with a set that lacks it.  Runs meet the sets by blocks of places,
    and members are listed only after that, so they are never shuffled.
    """
    line = set_timeline(packs).where("set_id is not null")
    if used is not None:
        line = line.join(used.select("set_id").distinct(), "set_id", "left_semi")
    on = ["owner", "jurisdiction"]
    first = stored(line.groupBy("set_id").agg(F.min(F.struct("at", *on)).alias("p")).select("set_id", "p.*"), "pack-set-places")
    places = stored(running_sum(first.withColumn("place", F.lit(1)), on, "at", ["place"]), "pack-set-numbers")
    valid = _valid(packs).select(F.col("id").alias("pack_id"), *on, "effective_from",
                                 F.coalesce("effective_to", F.lit(FOREVER).cast("timestamp")).alias("effective_to"))
    ends = valid.select(*on, F.explode(F.array("effective_from", "effective_to")).alias("end"))
    before = asof_lookup(ends, places.withColumn("_at", F.col("at")), on, "end", "at", ["_at", "place"]).select(
        # places earlier than the end itself
        *on, "end", F.coalesce(F.col("place") - (F.col("_at") == F.col("end")).cast("int"), F.lit(0)).alias("earlier"))
    before = stored(before, "pack-set-ends")

    def looked_up(column, name):
        return before.select(*on, F.col("end").alias(column), F.col("earlier").alias(name))

    runs = valid.join(looked_up("effective_from", "_begin"), [*on, "effective_from"]).join(looked_up("effective_to", "_end"), [*on, "effective_to"])
    named = first.join(places, [*on, "at"]).select(*on, _block(F.col("place")).alias("block"), F.struct("place", "set_id").alias("set"))
    blocks = stored(named.groupBy(*on, "block").agg(F.collect_list("set").alias("sets")), "pack-set-blocks")
    runs = runs.where("_end > _begin").withColumn("block", F.explode(F.sequence(_block(F.col("_begin") + 1), _block(F.col("_end")))))
    # few bytes that many members come of, so dealt to as many tasks as a shuffle has, not by size
    tasks = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = runs.repartition(tasks, "pack_id", "block").join(blocks, [*on, "block"])
    held = F.filter("sets", lambda s: (s["place"] > F.col("_begin")) & (s["place"] <= F.col("_end")))
    return met.select("pack_id", F.explode(held["set_id"]).alias("set_id")).select("set_id", "pack_id")


def _block(place: Column) -> Column:
    return F.floor(place / F.lit(BLOCK))


def owner_of(account_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), account_id.cast("string")), F.lit("*"))


def policy_snapshot(analyses: DataFrame, packs: DataFrame, at: str) -> DataFrame:
    """For every analysis, how many packs graded it, global and own, and the sum of their numbers.

    ``analyses`` has (account_id, jurisdiction, <at>); a jurisdiction is free
    text.  Instead of pairing each analysis with each pack, the packs become
    time lines of totals.  An analysis looks up four of them at its instant,
    global and own, for its jurisdiction and for everywhere, all in one pass;
    the work grows with the sum of the two tables, not their product.  Sums of
    equal pack sets are equal, and of different ones differ but for chance.
    """
    key = ["account_id", "jurisdiction", at]
    wide = _wide(analyses.select(*key).distinct(), key)
    asks = wide.select("owner", F.col("_where").alias("jurisdiction"), F.col(at).alias("_asked"))
    found = asof_lookup(asks, pack_timeline(packs), ["owner", "jurisdiction"], "_asked", "at", ["packs", "pack_ids"])
    found = found.select("owner", F.col("jurisdiction").alias("_where"), F.col("_asked").alias(at), "packs", "pack_ids")
    is_global = F.col("owner") == "*"
    sums = wide.join(found, ["owner", "_where", at]).groupBy(*key).agg(
        F.sum(F.when(is_global, F.col("packs"))).alias("global_packs"),
        F.sum(F.when(~is_global, F.col("packs"))).alias("own_packs"),
        F.sum("pack_ids").alias("pack_set"),
    )
    zero = F.lit(0)
    return analyses.join(sums, key, "left").select(
        *analyses.columns, *[F.coalesce(c, zero).cast("long").alias(c) for c in ("global_packs", "own_packs", "pack_set")])
