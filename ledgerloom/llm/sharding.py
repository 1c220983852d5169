"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows hash onto a ring of 65,536 places; each shard owns ``vnodes`` of them and serves the
places before each of its own. A shard takes at most its bound of rows: floor(n / shards),
one more for the first n mod shards of them. It takes its own rows first, in ring order;
what overflows goes on clockwise, oldest first, to the next virtual node whose shard has room.
Only overflowing rows leave their home shard, so movement is the least that the bounds allow.

Everything is counted per ring place (a fixed number of places, whatever the input), so no
shard's rows ever meet in one task: rows are ranked within a place, places within a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACES = 65536


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(place, vplace, home): for each place the virtual node that serves it and that node's shard.

    Two virtual nodes on one place: the smaller shard serves it. Of fixed size."""
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("v"))
        .select("shard", F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("node"), "shard", "v")), 1, 4), 16, 10).cast("int").alias("vplace"))
        .groupBy("vplace")
        .agg(F.min("shard").alias("home"))
    )
    marks = F.sort_array(F.collect_list(F.struct("vplace", "home")))
    spans = nodes.agg(marks.alias("m")).select(F.expr("posexplode(m)").alias("i", "node"), F.size("m").alias("n"), F.col("m"))
    # A node serves the places after the node before it; those after the last go to the first.
    before = F.when(F.col("i") > 0, F.expr("m[i - 1].vplace")).otherwise(F.lit(-1))
    served = F.sequence(before + 1, F.col("node.vplace"))
    last = F.expr("m[n - 1].vplace")
    wrapped = F.when((F.col("i") == 0) & (last < PLACES - 1), F.concat(served, F.sequence(last + 1, F.lit(PLACES - 1)))).otherwise(served)
    return spans.select(F.explode(wrapped).alias("place"), F.col("node.vplace").alias("vplace"), F.col("node.home").alias("home"))


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, home) for every row, by the law that shard counts differ by one at most.

    A null text has size 1 and the checksum 0 of no bytes; a null id is hashed by its text. Rows with
    equal ids lie at one place, in the order of size and checksum. An empty table gives no rows; other
    columns are not looked at."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("_crc"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))).alias("_h"),
    ).withColumn("_place", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))

    places = ring(spark, shards, vnodes)
    # Counts by place: PLACES rows at most.
    here = (
        docs.select(F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))).alias("_h"))
        .groupBy(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int").alias("place"))
        .agg(F.count("*").alias("n"))
    )
    counts = places.join(here, "place", "left").select("place", "vplace", "home", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    bound = F.expr(f"total div {shards}") + F.when(F.col("home") < F.col("total") % shards, 1).otherwise(0)
    in_home = Window.partitionBy("home").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    table = (
        counts.crossJoin(F.broadcast(total))  # one row
        .withColumn("bound", bound)
        .withColumn("before", F.coalesce(F.sum("n").over(in_home), F.lit(0)))
        .withColumn("over", F.greatest(F.lit(0), F.least("n", F.col("before") + F.col("n") - F.col("bound"))))
    )
    by_node = table.groupBy("vplace", "home", "bound").agg(F.sum("n").alias("n"), F.sum("over").alias("over"))
    # Clockwise over the nodes, twice: what is carried takes the room that shards have left after their own rows.
    own = by_node.groupBy("home", "bound").agg(F.sum("n").alias("n")).select("home", F.greatest(F.lit(0), F.col("bound") - F.col("n")).alias("room"), F.least("bound", "n").alias("kept"))
    one = by_node.agg(F.sort_array(F.collect_list(F.struct("vplace", "home", "over"))).alias("nodes")).crossJoin(
        own.agg(
            F.map_from_entries(F.collect_list(F.struct("home", "room"))).alias("rooms"),
            F.map_from_entries(F.collect_list(F.struct("home", "kept"))).alias("kept"),
        )
    )
    walk = f"""
        aggregate(
            concat(transform(nodes, x -> named_struct('home', x.home, 'over', x.over)), transform(nodes, x -> named_struct('home', x.home, 'over', 0L))),
            named_struct('carried', 0L, 'placed', 0L, 'rooms', transform(sequence(0, {shards - 1}), s -> coalesce(rooms[s], 0L)),
                         'slots', transform(sequence(0, {shards - 1}), s -> coalesce(kept[s], 0L)),
                         'spans', cast(array() as array<struct<shard:int,lo:bigint,hi:bigint,slot:bigint>>)),
            (a, x) -> case when a.carried + x.over = 0 or a.rooms[x.home] = 0 then named_struct('carried', a.carried + x.over, 'placed', a.placed, 'rooms', a.rooms, 'slots', a.slots, 'spans', a.spans)
                else named_struct(
                    'carried', a.carried + x.over - least(a.carried + x.over, a.rooms[x.home]),
                    'placed', a.placed + least(a.carried + x.over, a.rooms[x.home]),
                    'rooms', transform(a.rooms, (r, s) -> if(s = x.home, r - least(a.carried + x.over, r), r)),
                    'slots', transform(a.slots, (r, s) -> if(s = x.home, r + least(a.carried + x.over, a.rooms[x.home]), r)),
                    'spans', concat(a.spans, array(named_struct('shard', x.home, 'lo', a.placed, 'hi', a.placed + least(a.carried + x.over, a.rooms[x.home]), 'slot', a.slots[x.home])))) end,
            a -> a.spans)"""
    spans = one.select(F.expr(walk).alias("spans"))  # one row; a span for each stop at a shard with room

    # Overflow is numbered in ring order of the nodes, then of places.
    by_ring = Window.orderBy("vplace").rowsBetween(Window.unboundedPreceding, -1)  # over shards * vnodes rows at most
    node_at = by_node.select("vplace", F.coalesce(F.sum("over").over(by_ring), F.lit(0)).alias("node_over"))
    in_node = Window.partitionBy("vplace").orderBy("before", "place").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (
        table.withColumn("over_before", F.coalesce(F.sum("over").over(in_node), F.lit(0)))
        .join(F.broadcast(node_at), "vplace")  # shards * vnodes rows at most
        .select(F.col("place").alias("_place"), F.col("home").alias("_home"), "before", (F.col("n") - F.col("over")).alias("_stay"), (F.col("node_over") + F.col("over_before")).alias("_over_at"))
    )
    at_place = Window.partitionBy("_place").orderBy("_h", "_size", "_crc")
    ranked = (
        rows.withColumn("_r", F.row_number().over(at_place) - 1)
        .join(F.broadcast(dealt), "_place")  # PLACES rows
        .crossJoin(F.broadcast(spans))  # one row
        .withColumn("_g", F.when(F.col("_r") >= F.col("_stay"), F.col("_over_at") + F.col("_r") - F.col("_stay")))
        .withColumn("_span", F.when(F.col("_g").isNotNull(), F.expr("filter(spans, s -> s.lo <= _g and _g < s.hi)[0]")))
    )
    return ranked.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.coalesce("_span.shard", "_home").cast("int").alias("shard"),
        F.coalesce(F.expr("_span.slot + _g - _span.lo"), F.col("before") + F.col("_r")).cast("long").alias("slot"),
        F.col("_home").alias("home"),
    )
