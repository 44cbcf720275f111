"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document is expected in the mix
`target / size of its source` times. The whole part of that is certain: so
many copies of every document are taken. The fraction is an inclusion
probability p, and one more copy goes to the documents that come first by

    (u / (1 - u)) / (p / (1 - p))        u uniform in (0, 1), from a hash

until the source's remaining words are used up: a sample of fixed size
whose members have unequal probabilities. The last document seldom fits
exactly, so the gap it leaves is filled, in the same order, by documents
that are small enough. After three rounds it is a few words; of the
documents still left one is added if that brings the source nearer.

Nothing is sorted as a whole. The order of a source is read off a histogram
of 65,536 bins, looked at as 256 groups of 256, and only the documents of
the bin in which the words run out are ordered one by one.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source of its own; equal rows are numbered and ranked one by one,
so that any number of them may be taken, which of them being all the same; an
empty table gives no rows; extra columns are ignored by `mix`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_BYTES, cut, ship
from ledgerline.llm.ordering import numbered

WORD = r"[^\x20\x09-\x0D]+"
_BINS, _GROUP = 65_536, 256


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float
) -> DataFrame:
    """Targets per source: by weight, none above `cap` times its size.

    `sizes` has one row per source: source, source_size. Sources by code
    point, null last, take the weights in turn. What a capped source leaves
    goes to the others by weight, so every other target is weight times one
    level; sorted by cap / weight, the capped ones come first and the level
    is where that stops.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    rows = sizes.select(
        "source",
        "source_size",
        F.row_number().over(by_name).alias("source_no"),
        F.element_at(F.array(*map(F.lit, map(float, weights))), turn).alias("weight"),
    ).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    fits = F.when(level <= F.col("most") / F.col("weight"), F.struct(F.row_number().over(order), level))
    return (
        rows.withColumn("fits", fits)
        .withColumn("level", F.min("fits").over(everything)["col2"])
        .select(
            "source",
            "source_no",
            "source_size",
            F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"),
        )
    )


def _drawn(rounds: int) -> Column:
    """Whether one of the rounds so far took the row."""
    taken = F.lit(False)
    for r in range(rounds):
        here = F.struct("rank", "tie") <= F.struct(f"rank_{r}", f"tie_{r}")
        fits = (F.col("size") <= F.col(f"room_{r}")) & (F.col("chance") > 0)
        first = F.col(f"bin_{r}").isNull() | (F.col("bin") < F.col(f"bin_{r}"))
        last = (F.col("bin") == F.col(f"bin_{r}")) & F.coalesce(here, F.lit(False))
        taken = taken | (fits & (first | last))
    return taken


def _closest(pool: DataFrame, room: DataFrame) -> DataFrame:
    """Per source the document nearest in size to the words still missing, below twice as many."""
    off = F.abs(F.col("size") - F.col("room"))
    return (
        pool.where(off < F.col("room"))
        .groupBy("source_no")
        .agg(F.min(F.struct(off, "rank", "tie")).alias("best"))
        .select("source_no", F.col("best.tie").alias("last_tie"))
    )


def _round(pool: DataFrame, room: DataFrame, r: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Where the words of each source run out when taking `pool` by rank.

    Returns per source the bin, the last rank and tie taken in it (null:
    none), and the words left. No bin: everything fitted. `small` marks a
    table with a row per source for a broadcast, if there are few enough.
    """
    fine = cut(pool.groupBy("source_no", "bin").agg(F.sum("size").alias("words")))
    group = F.floor(F.col("bin") / _GROUP).cast("int")
    coarse = fine.groupBy("source_no", group.alias("group")).agg(F.sum("words").alias("words"))
    ordered = Window.partitionBy("source_no").orderBy("group")
    edge = (
        coarse.withColumn("upto", F.sum("words").over(ordered))
        .join(small(room), "source_no")
        .where(F.col("upto") > F.col("room"))
        .groupBy("source_no")
        .agg(F.min(F.struct("group", (F.col("upto") - F.col("words")).alias("used"))).alias("edge"))
        .select("source_no", "edge.*")
    )
    ordered = Window.partitionBy("source_no").orderBy("bin")
    edge = cut(
        fine.withColumn("group", group)
        .join(edge, ["source_no", "group"])
        .withColumn("upto", F.col("used") + F.sum("words").over(ordered))
        .join(small(room), "source_no")
        .where(F.col("upto") > F.col("room"))
        .groupBy("source_no")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("used"))).alias("edge"))
        .select("source_no", F.col("edge.bin").alias(f"bin_{r}"), F.col("edge.used").alias("used"))
    )
    ordered = Window.partitionBy("source_no").orderBy("rank", "tie")
    last = (
        pool.join(small(edge), "source_no")
        .where(F.col("bin") == F.col(f"bin_{r}"))
        .withColumn("upto", F.col("used") + F.sum("size").over(ordered))
        .join(small(room), "source_no")
        .where(F.col("upto") <= F.col("room"))
        .groupBy("source_no")
        .agg(F.max(F.struct("rank", "tie", "upto")).alias("last"))
    )
    spent = fine.groupBy("source_no").agg(F.sum("words").alias("all_words"))
    return cut(
        room.join(edge, "source_no", "left")
        .join(last, "source_no", "left")
        .join(spent, "source_no", "left")
        .select(
            "source_no",
            F.col("room").alias(f"room_{r}"),
            f"bin_{r}",
            F.col("last.rank").alias(f"rank_{r}"),
            F.col("last.tie").alias(f"tie_{r}"),
            (
                F.col("room")
                - F.coalesce("last.upto", "used", F.when(F.col(f"bin_{r}").isNull(), F.col("all_words")), F.lit(0))
            ).alias("room"),
        )
    )


def _apart(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows, those of a repeated `tie` with ties of their own."""
    marked = rows.join(repeated.withColumn("again", F.lit(True)), "tie", "left")
    others = [name for name in rows.columns if name != "tie"]
    own = numbered(marked.where("again"), "tie", [], others)
    own = own.withColumn("tie", F.xxhash64("tie", "number"))
    return marked.where(F.col("again").isNull()).select(rows.columns).union(own.select(rows.columns))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    cap: int = 3,
    seed: int = 20,
    rounds: int = 3,
    odds: Column | None = None,
    keep: tuple[str, ...] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Copies of each document that bring every source near its target.

    `odds`, a positive number per row, makes some documents of a source more
    likely than others (default: alike). `keep` names columns of `docs` to
    return beside doc_id, size, source_size, target, taken and copies.
    The number of sources is taken to be small enough for one task; their
    table is broadcast below `broadcast_bytes` and joined by shuffles above.
    """
    ship(docs.sparkSession)
    named = ["doc_id", "source", "text", *(name for name in keep if name not in ("doc_id", "source", "text"))]
    sized = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), *named).alias("tie"),
        (F.lit(1.0) if odds is None else odds).cast("double").alias("odds"),
        *(F.col(name).alias(f"kept_{name}") for name in keep),
    )
    narrow = cut(sized.select("doc_id", "source", "size", "tie", "odds"))
    repeated = cut(narrow.groupBy("tie").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("tie"))
    again = repeated.count()
    if again:
        repeated = F.broadcast(repeated) if again * 16 < broadcast_bytes else repeated
        narrow = cut(_apart(narrow, repeated))
        sized = _apart(sized, repeated) if keep else sized
    sizes = narrow.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("odds")).alias("odds_size")
    )
    sources = cut(
        source_targets(sizes.drop("odds_size"), weights, share, cap)
        .alias("t")
        .join(sizes.alias("s"), F.expr("t.source <=> s.source"))
        .select("t.*", "s.odds_size")
    )
    bytes_ = sources.agg(F.sum(F.lit(64) + F.coalesce(F.octet_length("source"), F.lit(0)))).first()[0]
    small = F.broadcast if (bytes_ or 0) < broadcast_bytes else lambda frame: frame

    def ranked(rows: DataFrame, state: DataFrame) -> DataFrame:
        rows = rows.alias("d").join(
            small(state.alias("s")), F.expr("d.source <=> s.source")
        ).drop(F.col("s.source"))
        times = F.coalesce(
            F.try_divide(F.col("target") * F.col("odds"), F.col("odds_size")), F.lit(0.0)
        )
        rows = rows.withColumn("times", F.least(F.lit(float(cap)), times))
        rows = rows.withColumn("whole", F.floor("times"))
        rows = rows.withColumn("chance", F.col("times") - F.col("whole"))
        u = (F.shiftrightunsigned("tie", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        rows = rows.withColumn("rank", u * (1 - F.col("chance")))
        rows = rows.withColumn(
            # q / (1 + q), which orders as q = (u / (1 - u)) / (chance / (1 - chance)) does
            "rank",
            F.coalesce(F.try_divide(F.col("rank"), F.col("rank") + (1 - u) * F.col("chance")), F.lit(1.0)),
        )
        return rows.withColumn("bin", F.least(F.floor(F.col("rank") * _BINS), F.lit(_BINS - 1)).cast("int"))

    room = cut(
        ranked(narrow, sources)
        .groupBy("source_no", "target")
        .agg(F.sum(F.col("size") * F.col("whole")).alias("certain"))
        .select("source_no", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("room"))
    )
    state = sources
    for r in range(rounds):
        before = state.join(room, "source_no")
        pool = ranked(narrow, before).where(
            (F.col("chance") > 0) & (F.col("size") <= F.col("room")) & ~_drawn(r)
        ).select("source_no", "bin", "rank", "tie", "size")
        found = _round(pool, room, r, small)
        state = cut(state.join(found.drop("room"), "source_no"))
        room = found.select("source_no", "room")
    left = ranked(narrow, state.join(room, "source_no")).where((F.col("chance") > 0) & ~_drawn(rounds))
    state = cut(state.join(_closest(left, room), "source_no", "left"))
    drawn = _drawn(rounds) | F.coalesce((F.col("tie") == F.col("last_tie")) & (F.col("size") > 0), F.lit(False))
    mixed = ranked(sized if keep else narrow, state).withColumn(
        "copies", F.col("whole") + F.when(drawn, 1).otherwise(0)
    )
    return mixed.select(
        "doc_id",
        *(F.col(f"kept_{name}").alias(name) for name in keep if name != "doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.col("copies").cast("long").alias("copies"),
    )
