"""XML records as rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismdex.operators.sizing import measure
from prismdex.sources.store import write_once

# Where the product fields stand within a record; `//` is any depth.
PRODUCT_PATHS = {
    "title": "title",
    "Material": "properties//material",
    "Style": "properties//style",
    "Mounting": "properties//mounting",
    "Brand": "properties//brand",
}

PRODUCT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("properties", T.StructType([
        T.StructField(name, T.StringType()) for name in ("material", "style", "mounting", "brand")])),
])


def read_products(spark: SparkSession, path: str, row_tag: str = "product",
                  schema: T.StructType = PRODUCT_SCHEMA) -> DataFrame:
    """Records bound to a schema by the built-in XML source; malformed records raise."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)


# The sections of XML in which tags are plain text, as (opening, closing). A reader is in state 0
# outside of them and in state n inside a section of the n-th kind.
SECTIONS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))
UNMOVED = "0123"
_MARK = re.compile(r"([\[\]?!])")


def _end_state(piece: Column) -> Column:
    """The state that a piece ends in when it is read from state 0.

    One pass empties every section, closed or not; an opening left at the very end was never closed.
    """
    section = "|".join(
        rf"({_MARK.sub(r'\\\1', begin)})(?s:.*?)({_MARK.sub(r'\\\1', end)}|\z)" for begin, end in SECTIONS)
    emptied = F.regexp_replace(piece, section, "".join(f"${n}" for n in range(1, 2 * len(SECTIONS) + 1)))
    state = F.lit("0")
    for n, (begin, _) in enumerate(SECTIONS, 1):
        state = F.when(F.endswith(emptied, F.lit(begin)), F.lit(str(n))).otherwise(state)
    return F.when(F.contains(piece, F.lit("<!")) | F.contains(piece, F.lit("<?")), state).otherwise(F.lit("0"))


def _move(piece: Column) -> Column:
    """The states that a piece ends in when it is read from state 0, 1, 2 and 3, one digit each."""
    ends = [_end_state(piece)]
    for n, (begin, end) in enumerate(SECTIONS, 1):
        ends.append(F.when(F.contains(piece, F.lit(end)), _end_state(F.concat(F.lit(begin), piece))).otherwise(F.lit(str(n))))
    return F.concat(*ends)


def _through(moves: pd.DataFrame) -> pd.DataFrame:
    """One file split as one move."""
    states = [0, 1, 2, 3]
    for move in moves.sort_values("at")["move"]:
        states = [int(move[s]) for s in states]
    return moves[["file", "block"]].head(1).assign(through="".join(map(str, states)))


def _starts(splits: pd.DataFrame) -> pd.DataFrame:
    """The state that each split of a file is entered in."""
    splits, state, starts = splits.sort_values("block"), 0, []
    for move in splits["through"]:
        starts.append(state)
        state = int(move[state])
    return splits.assign(start=starts)[["file", "block", "low", "high", "dirty", "start"]]


def _spans(moves: pd.DataFrame) -> pd.DataFrame:
    """The runs of pieces of one split that false cuts made of one; `whole` is null for a run begun in an earlier split."""
    moves = moves.sort_values("at")
    file, block, low, high, state = moves[["file", "block", "low", "high", "start"]].iloc[0]
    begun, whole, spans = low, None, []
    for at, move in zip(moves["at"], moves["move"]):
        if move is None:  # a split without a move
            continue
        after = int(move[state])
        if not state and after:
            begun = whole = at
        if state and not after:
            spans.append((begun, at, whole, False))
        state = after
    if state:
        spans.append((begun, high, whole, True))
    out = pd.DataFrame(spans, columns=["low", "high", "whole", "open"]).astype({"whole": "Int64"})
    return out.assign(file=file, block=block)[["file", "block", "low", "high", "whole", "open"]]


def _rejoin(pieces: DataFrame, row_tag: str) -> DataFrame:
    """(piece): the pieces, with those that false cuts made of one put together again.

    Whether a cut is real depends on all text of its file before it. Every piece moves a reader from state to state:
    the moves of a split are taken together for each state it may be entered in, the splits of a file, one row
    each, are followed in order, and then the moves of the splits that a section reaches over a cut in. These steps
    see a few characters per piece; only pieces beside a false cut leave the task that reads them.
    """
    split = ["file", "block"]
    moves = pieces.select(*split, "at", _move(F.col("piece")).alias("move"))
    moves = write_once(moves.where((F.col("move") != UNMOVED)), "xml-moves")
    through = moves.groupBy(*split).applyInPandas(_through, "file string, block long, through string")
    dirty = moves.groupBy(*split).agg(F.expr("bool_or(left(move, 1) <> '0')").alias("dirty"))
    splits = pieces.groupBy(*split).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    splits = splits.join(through, split, "left").join(dirty, split, "left").fillna({"through": UNMOVED, "dirty": False})
    entered = splits.groupBy("file").applyInPandas(
        _starts, "file string, block long, low long, high long, dirty boolean, start int")
    spans = entered.where("dirty OR start <> 0").join(moves, split, "left").groupBy(*split).applyInPandas(
        _spans, "file string, block long, low long, high long, whole long, open boolean")
    spans = write_once(spans, "xml-spans")
    # At most two runs of a split reach beyond it; they alone are followed over the splits of their file.
    before = W.partitionBy("file").orderBy("block", "low")
    reaching = spans.where("open OR whole IS NULL").withColumn("whole", F.last("whole", ignorenulls=True).over(before))
    spans = spans.where("NOT open AND whole IS NOT NULL").unionByName(reaching)
    odd = spans.select("block", "whole", F.explode(F.sequence("low", "high")).alias("at"))
    size = measure(odd)
    odd = F.broadcast(odd) if size.small else odd
    plain = pieces.join(odd, "at", "left_anti").select("piece")
    parts = pieces.drop("block").join(odd, "at").groupBy("whole").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "piece"))).alias("parts"))
    return plain.unionByName(parts.select(F.array_join(F.expr("parts.piece"), f"</{row_tag}>").alias("piece")))


def read_record_texts(spark: SparkSession, path: str, row_tag: str = "product") -> DataFrame:
    """(record): the XML text of every record, without its comments and processing instructions.

    Files are cut at the closing tag, so one large file is read by many tasks. A closing tag inside a comment, a CDATA
    section or an instruction ends no record. Files where that occurs, found by a first
    pass over the pieces that hold a section at all, are written once with the place of each piece.

    The closing tag must be written without white space. Files without a record give no row. A file that ends
    inside a section gives one record of all that follows its opening, if that holds an opening tag.
    """
    pieces = spark.read.option("lineSep", f"</{row_tag}>").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    if not pieces.where(_end_state(F.col("piece")) != "0").isEmpty():
        pieces = _rejoin(write_once(pieces, "xml-pieces"), row_tag)
    bare = F.regexp_replace("piece", r"(<!\[CDATA\[(?s:.*?)\]\]>)|<!--(?s:.*?)-->|<\?(?s:.*?)\?>", "$1")
    record = F.regexp_extract(bare, rf"(?s)<{row_tag}(?:\s[^>]*)?>.*", 0)
    return pieces.select(record.alias("body")).where("body <> ''").select(
        F.concat("body", F.lit(f"</{row_tag}>")).alias("record"))


def extract_fields(records: DataFrame, paths: dict[str, str] = PRODUCT_PATHS, row_tag: str = "product",
                   on_missing: str = "raise") -> DataFrame:
    """One column per path: the first match in document order.

    A record without a match raises, or with `on_missing="quarantine"` is kept with nulls
    and the names of its missing fields in `missing`.
    """
    if on_missing not in ("raise", "quarantine"):
        raise ValueError("on_missing must be 'raise' or 'quarantine'")
    found = records.select("record", *[
        F.when(F.xpath_boolean("record", F.lit(f"boolean(/{row_tag}/{path})")),
               F.xpath_string("record", F.lit(f"/{row_tag}/{path}"))).alias(name)
        for name, path in paths.items()])
    if on_missing == "quarantine":
        absent = F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in paths])
        return found.select(*paths, F.array_compact(absent).alias("missing"))
    return found.select(*[
        F.coalesce(name, F.raise_error(F.concat(F.lit(f"record without {name}: "), F.substr("record", F.lit(1), F.lit(200)))))
        .alias(name) for name in paths])
