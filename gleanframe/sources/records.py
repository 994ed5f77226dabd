"""Records of CSV files whose quotes hold line breaks, read by many tasks.

A line maps the state before it (outside or inside quotes) to the state after it, and lines can be read from any place
of a file.  So each block of a file is mapped as a whole first, the blocks' maps are combined in file order (one row per
block), and then every line knows how it begins and which record it belongs to.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK = ["file", "block"]


def _left_open(line: Column, separator: str) -> Column:
    """Whether a line without doubled quotes that begins outside quotes ends inside them.

    A quote opens only at the start of a field; what follows a closing quote up to the separator counts for nothing.
    """
    sep = re.escape(separator)
    # the quote comes first in the patterns, then what stands before it: so a search looks at quotes, not at every sign
    rest = F.regexp_replace(line, f'"(?<=(?:^|{sep})")[^"]*+"[^{sep}]*+', "")
    return rest.rlike(f'"(?<=(?:^|{sep})")')


def _bare(line: Column) -> Column:
    """One sign per byte of a line, doubled quotes left out; bytes that are no UTF-8 would swallow the quote after them."""
    return F.replace(F.decode(line.cast("binary"), "ISO-8859-1"), F.lit('""'), F.lit(""))


def opens_quote(line: Column, separator: str) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    return F.when(F.contains(line, F.lit('"')), _left_open(_bare(line), separator)).otherwise(False)


def stays_inside(line: Column, separator: str) -> Column:
    """Whether a line that begins inside quotes ends inside them."""
    bare = _bare(line)
    closed = F.instr(bare, '"')
    left_open = F.when(closed == 0, True).otherwise(_left_open(F.concat(F.lit("x"), F.substr(bare, closed + 1)), separator))
    return F.when(F.contains(line, F.lit('"')), left_open).otherwise(True)


def _states_before(maps: DataFrame, within: Sequence[str], order: str, **first: int) -> DataFrame:
    """``maps`` (``from_out``, ``from_in``) with the state before each row, one column per state before the first row.

    States are 0 outside and 1 inside quotes.  Rows either fix the state, turn it, or leave it: what counts is the last
    row that fixed it and the turns since.
    """
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("from_out") > F.col("from_in"), 1).otherwise(0)
    turned = maps.withColumn("turned", F.coalesce(F.sum(turn).over(earlier), F.lit(0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"), (F.col("from_out") + F.col("turned")) % 2)
    last = turned.withColumn("fixed", fixed).withColumn("last", F.last("fixed", ignorenulls=True).over(earlier))
    states = {name: ((F.coalesce("last", F.lit(at)) + F.col("turned")) % 2).cast("int") for name, at in first.items()}
    return last.withColumns(states).drop("turned", "fixed", "last")


def quoted_records(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", separator: str = ",") -> DataFrame:
    """(file, block, record, text, is_first): one row per record, the first filled one marked; line breaks inside quotes become ``\\n``.

    Lines are shuffled once, by blocks of files, which bounds what a task sorts; only records that reach over the end of a
    block are shuffled again.  ``encoding`` must agree with ASCII on quotes, separators and line ends.  Blocks must be cut
    alike in both readings: a cluster whose number of cores changed in between gets an error, never other records.
    """
    state = lambda flag: F.coalesce(flag, F.lit(False)).cast("int")                       # noqa: E731
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",                          # grows within a block
        state(opens_quote(F.col("value"), separator)).alias("from_out"),
        state(stays_inside(F.col("value"), separator)).alias("from_in"))
    lines = _states_before(lines, BLOCK, "line", if_out=0, if_in=1)

    after = lambda before: F.when(F.col(before) == 0, F.col("from_out")).otherwise(F.col("from_in"))
    blocks = lines.groupBy(*BLOCK).agg(
        F.count_if(F.col("if_out") == 0).alias("starts_out"), F.count_if(F.col("if_in") == 0).alias("starts_in"),
        F.max_by(after("if_out"), "line").alias("from_out"), F.max_by(after("if_in"), "line").alias("from_in"))
    blocks = _states_before(blocks, ["file"], "block", inside=0).withColumn(
        "starts", F.when(F.col("inside") == 0, F.col("starts_out")).otherwise(F.col("starts_in")))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *BLOCK, "inside", "starts",
        F.when(F.col("inside") == 0, F.col("from_out")).otherwise(F.col("from_in")).alias("left_open"),
        F.last(F.when(F.col("starts") > 0, F.struct("block", "starts")), ignorenulls=True).over(in_file).alias("owner"))

    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit(
        "blocks of a file were cut differently; set spark.sql.files.minPartitionNum"))).otherwise(F.col("inside"))
    begun = Window.partitionBy(*BLOCK).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts_here = F.when(known == 0, F.col("if_out")).otherwise(F.col("if_in")) == 0
    numbered = lines.join(blocks, BLOCK, "left").withColumn("record", F.sum(starts_here.cast("bigint")).over(begun))
    filled = F.when(F.col("value").rlike(r"\S"), F.col("record"))
    numbered = numbered.withColumn("header", F.min(filled).over(Window.partitionBy(*BLOCK)))
    if encoding.upper() not in ("UTF-8", "UTF8"):
        numbered = numbered.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    pieces = numbered.groupBy(*BLOCK, "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda one: one["value"]), "\n").alias("text"),
        *[F.first(c).alias(c) for c in ("owner", "starts", "left_open", "header")])
    is_first = (F.col("block") == 0) & (F.col("record") == F.col("header"))

    # a block's lines before its first start belong to the last start before; its last record may go on in the next block
    crossing = (F.col("record") == 0) | ((F.col("left_open") == 1) & (F.col("record") == F.col("starts")))
    own = pieces.filter(~crossing).select(*BLOCK, "record", "text", is_first.alias("is_first"))
    led = F.col("record") == 0
    joined = pieces.filter(crossing).select(
        "file", F.when(led, F.col("owner.block")).otherwise(F.col("block")).alias("of"),
        F.when(led, F.col("owner.starts")).otherwise(F.col("record")).alias("record"), F.struct("block", "text").alias("piece"),
        is_first.alias("is_first"))
    joined = joined.groupBy("file", "of", "record").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("piece")), lambda one: one["text"]), "\n").alias("text"), F.bool_or("is_first").alias("is_first"))
    return own.unionByName(joined.withColumnRenamed("of", "block"))
