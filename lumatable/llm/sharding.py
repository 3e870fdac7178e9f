"""Sharding by a uniform shuffle with exact shard sizes, in DataFrame operations only.

The law is ``rows``: shard sizes differ by at most one row, and every assignment of rows to shards with
these sizes is equally likely. How many rows go from each input partition to each shard is drawn
first, as a communication matrix of the hypergeometric law: its rows add up to the partitions' sizes, its
columns to the shards' sizes, and no row has been looked at. Then

1. rows are permuted inside their partition, without a shuffle, and written with their place;
2. the place and the partition's row of the matrix give the shard;
3. rows are exchanged into ranges of (shard, random number) and sorted there: that is the second
   permutation. A shard is many ranges, so no task holds one; the number of a row is its slot.

The matrix is drawn from the top: partitions are halved again and again, and each half gets its share of
every shard, shard by shard, from what is left of the node. Nodes of a level are rows of a table, so
levels run in parallel and are about as many as the logarithm of the number of partitions. A single
draw is by inversion: weights of the hypergeometric law around its mode, each from its neighbour,
``REACH`` standard deviations to both sides (what lies beyond has less weight than a double holds).

All random numbers are hashes of the seed and a place, so a rerun over the same partitions agrees.
Equal texts are not kept together; a group of copies is dealt over all shards, as any rows.

Defined results: null text has size 8 and checksum 0; rows with equal or null ids are rows of their own;
an empty table gives an empty result; fewer rows than shards leave the last shards empty; other columns
are kept, but for one of the name ``shard_place``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop_staged, stage_table

SHARDS = 24
SEED = 1
REACH = 12
LAW = "rows"
#: Rows of a partition are numbered in the low bits of ``monotonically_increasing_id``.
PLACE_BITS = 33
_UNIT = 1.0 / (1 << 53)


def _random(seed: int, *place: Column) -> Column:
    return F.xxhash64(F.lit(seed), *place)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value reckoned once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(total: Column, good: Column, take: Column, unit: Column) -> Column:
    """How many of ``take`` rows out of ``total`` are among the ``good`` ones, for a number in [0, 1)."""
    low = F.greatest(F.lit(0).cast("long"), take + good - total)
    high = F.least(good, take)
    n, k, m = F.greatest(total.cast("double"), F.lit(1.0)), good.cast("double"), take.cast("double")
    middle = F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")
    spread = F.sqrt(F.greatest(F.lit(0.0), m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0))))
    facts = F.struct(
        n.alias("n"), k.alias("k"), m.alias("m"), low.alias("low"), high.alias("high"), unit.alias("unit"),
        F.greatest(low, F.least(high, middle)).alias("mode"), (F.ceil(spread * REACH).cast("long") + 30).alias("half"),
    )
    return _let(facts, lambda f: F.when(f["low"] == f["high"], f["low"]).otherwise(_inverted(f)))


def _inverted(f: Column) -> Column:
    """The first place whose weights, added up from the mode upward and then downward, pass the goal."""
    mode = f["mode"]
    up = F.sequence(mode, F.least(f["high"], mode + f["half"]))
    # the mode itself is left out on the way down
    down = F.when(
        mode > f["low"], F.reverse(F.sequence(F.greatest(f["low"], mode - f["half"]), F.greatest(f["low"], mode - 1)))
    ).otherwise(F.array().cast("array<long>"))

    def weight(before: Column, x: Column) -> Column:
        """The weight of x from the weight of its neighbour on the way from the mode."""
        d = x.cast("double")
        rest = f["n"] - f["k"] - f["m"] + d
        rise = before * (f["k"] - d + 1) * (f["m"] - d + 1) / (d * rest)
        fall = before * (d + 1) * (rest + 1) / ((f["k"] - d) * (f["m"] - d))
        return F.when(x == mode, F.lit(1.0)).when(x > mode, rise).otherwise(fall)

    def state(w, added, found):
        return F.struct(w.cast("double").alias("w"), added.cast("double").alias("s"), found.cast("long").alias("x"))

    def walk(places, added, goal):
        def step(st, x):
            return _let(
                F.struct(weight(st["w"], x).alias("w"), st["s"].alias("s"), st["x"].alias("x")),
                lambda now: state(now["w"], now["s"] + now["w"], F.coalesce(now["x"], F.when(now["s"] + now["w"] > goal, x))),
            )

        return F.aggregate(places, state(F.lit(1.0), added, F.lit(None)), step)

    never = F.lit(float("inf"))
    sums = F.struct(walk(up, F.lit(0.0), never)["s"].alias("up"), walk(down, F.lit(0.0), never)["s"].alias("down"))
    return _let(
        sums,
        lambda t: F.coalesce(
            walk(up, F.lit(0.0), f["unit"] * (t["up"] + t["down"]))["x"],
            walk(down, t["up"], f["unit"] * (t["up"] + t["down"]))["x"],
            mode,  # rounding may leave nothing for the very last place
        ),
    )


def _left_share(caps: Column, take: Column, node: Column, level: Column, seed: int, shards: int) -> Column:
    """What the left half of a node gets of every shard: ``take`` rows in all."""
    total = F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(
        total.alias("total"), take.cast("long").alias("take"), F.array().cast("array<long>").alias("out"),
    )

    def draw(st, s):
        unit = F.shiftrightunsigned(_random(seed, level, node, s), 11).cast("double") * _UNIT
        good = F.element_at(caps, s)
        x = hypergeometric(st["total"], good, st["take"], unit)
        return F.struct(
            (st["total"] - good).alias("total"), (st["take"] - x).alias("take"), F.concat(st["out"], F.array(x)).alias("out"),
        )

    return F.aggregate(F.array(*[F.lit(s) for s in range(1, shards + 1)]), start, draw)["out"]


def communication_matrix(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``part, row`` from ``part, n``: how many rows each partition (from 0 on) sends to every shard."""
    spark = counts.sparkSession
    rows, last = counts.agg(F.sum("n"), F.max("part")).first()
    if not rows:
        return counts.select(F.col("part").cast("long").alias("part"), F.array().cast("array<long>").alias("row"))
    levels = int(last).bit_length()
    caps = [rows // shards + (s < rows % shards) for s in range(shards)]
    nodes = spark.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(c).cast("long") for c in caps]).alias("caps"))
    share = _left_share(F.col("caps"), F.col("_take"), F.col("node"), F.col("_level"), seed, shards)
    for level in range(levels):
        # rows in the left half of every node
        half = F.shiftright(F.col("part").cast("long"), levels - level - 1)
        left = counts.select(half.alias("_half"), "n").filter(half % 2 == 0)
        left = left.groupBy("_half").agg(F.sum("n").alias("_take"))
        both = nodes.join(left, F.col("node") * 2 == F.col("_half"), "left")
        # few bytes but much to reckon: AQE would put all nodes into one task
        both = both.repartition(min(1 << level, spark.sparkContext.defaultParallelism), "node")
        both = both.select("node", "caps", F.coalesce("_take", F.lit(0)).cast("long").alias("_take"), F.lit(level).alias("_level"))
        pair = _let(share, lambda x: F.array(
            F.struct((F.col("node") * 2).alias("node"), x.alias("caps")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("caps", x, lambda a, b: a - b).alias("caps")),
        ))
        below = stage_table(both.select(F.inline(pair)), "matrix")
        if level:
            drop_staged(nodes)
        nodes = below.filter(F.exists("caps", lambda c: c > 0))
    return nodes.select(F.col("node").alias("part"), F.col("caps").alias("row"))


def _part(number: Column) -> Column:
    return F.shiftright(number, PLACE_BITS)


def _place(number: Column) -> Column:
    return number.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def sharded(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard_place``: a struct of ``shard`` (from 0) and ``slot`` (from 0, without gaps)."""
    columns = [F.col(c) for c in df.columns if c != "shard_place"]
    # sorting by a hash of the place permutes a partition; the place after it is written with the row
    permuted = df.select(F.struct(*columns).alias("_row"), _random(seed, F.monotonically_increasing_id()).alias("_first"))
    permuted = permuted.sortWithinPartitions("_first").select("_row", F.monotonically_increasing_id().alias("_at"))
    permuted = stage_table(permuted, "permuted")
    counts = stage_table(permuted.groupBy(_part(F.col("_at")).alias("part")).agg(F.count("*").alias("n")), "parts")
    matrix = communication_matrix(counts, shards, seed)
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.aggregate(F.slice("row", 1, s), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    matrix = stage_table(matrix.select(F.col("part").alias("_part"), ends.alias("_ends")), "ends")
    # a partition of the input has one row here; whether it is broadcast follows from the written size
    shard = F.size(F.filter("_ends", lambda e: e <= _place(F.col("_at"))))
    sent = permuted.join(matrix, _part(F.col("_at")) == F.col("_part"))
    sent = sent.select("_row", "_at", shard.alias("shard"), _random(seed + 1, F.col("_at")).alias("_second"))

    dealt = sent.repartitionByRange("shard", "_second", "_at").sortWithinPartitions("shard", "_second", "_at")
    dealt = stage_table(dealt.select("_row", "shard", F.monotonically_increasing_id().alias("_to")), "dealt")
    drop_staged(permuted)
    # shards run on from one range to the next: a row per range and shard tells where it starts
    pieces = dealt.groupBy(_part(F.col("_to")).alias("_range"), "shard").agg(
        F.count("*").alias("_n"), F.min(_place(F.col("_to"))).alias("_from")
    )
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")
    pieces = stage_table(pieces.select("_range", F.col("shard").alias("_shard"), start.alias("_start")), "pieces")
    out = dealt.join(pieces, (_part(F.col("_to")) == F.col("_range")) & (F.col("shard") == F.col("_shard")))
    slot = _place(F.col("_to")) + F.col("_start")
    return out.select("_row.*", F.struct(F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot")).alias("shard_place"))


def sizes_and_checks(text: Column) -> tuple[Column, Column]:
    """UTF-8 bytes plus 8, and the unsigned CRC-32."""
    return (
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"),
    )


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> tuple[str, str]:
    """Write ``df`` as Parquet, a folder per shard; returns the names of the shard and slot columns.

    They are ``shard`` and ``slot``, with underscores added while ``df`` has such a column.
    """
    out = sharded(df, shards, seed)
    names = []
    for name in ("shard", "slot"):
        while name in df.columns:
            name += "_"
        names.append(name)
        out = out.withColumn(name, F.col("shard_place")[name.rstrip("_")])
    # ranges of (shard, slot) become files, so a shard is as many files as its size asks for
    out = out.drop("shard_place").repartitionByRange(*names).sortWithinPartitions(*names)
    out.write.partitionBy(names[0]).parquet(path)
    return tuple(names)
