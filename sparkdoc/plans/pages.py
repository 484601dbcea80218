"""All pages of a query at once: its rows numbered in the query's order by one distributed sort, and pages cut from the numbers.

A client that follows cursors asks for one page after the other, and each reads the collection anew. Whoever wants all of
them gets the same pages here from a number of jobs that doesn't depend on how many there are. The driver gets two counts
for each ``BLOCK`` rows, and one bit a row where pages may end by their limit and by their budget of rows too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sort import encode_cursor
from ..sources.exchange import shared_folder

#: Rows of a sorted partition that are counted together, as a power of two.
BLOCK = 14


@dataclass(frozen=True)
class Numbered:
    """``rows`` have ``_rank``, their place from 0 on, and ``_before``: how many of the rows before their block are matches."""

    rows: DataFrame
    walk: DataFrame
    bases: dict[int, int]  # each block's first rank
    n: int


def numbered(rows: DataFrame, order: list[Column]) -> Numbered:
    """Numbers rows in an order. ``_hit``, where they have it, tells the matches; else all are.

    The sorted rows are written once, so that numbers stay what they are however often they are read.
    """
    spark = rows.sparkSession
    at = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    rows = rows if "_hit" in rows.columns else rows.withColumn("_hit", F.lit(True))
    # partition and place in it, in this order
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    walk = spark.read.parquet(at).withColumn("_block", F.shiftright("_at", BLOCK))
    counts = sorted(walk.groupBy("_block").agg(F.count(F.lit(1)), F.count_if("_hit")).collect())
    first, hits = (np.cumsum([0, *[r[i] for r in counts]]).tolist() for i in (1, 2))
    bases = {r[0]: a for r, a in zip(counts, first, strict=False)}
    places = spark.createDataFrame([(r[0], a, h) for r, a, h in zip(counts, first, hits, strict=False)], "_block bigint, _first bigint, _before bigint")
    rank = F.col("_first") + F.col("_at").bitwiseAND((1 << BLOCK) - 1)
    return Numbered(walk.join(F.broadcast(places), "_block").withColumn("_rank", rank).drop("_first"), walk, bases, first[-1])


def _bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: _at, _hit, each file's rows in order. Yields (at, n, bits) of runs of rows that follow each other."""
    for batch in batches:
        at, hit = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = [0, *(np.flatnonzero((np.diff(at) != 1) | (at[1:] >> BLOCK != at[:-1] >> BLOCK)) + 1).tolist(), len(at)]
        runs = [(int(at[a]), b - a, np.packbits(hit[a:b].astype(bool)).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if runs:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*runs, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["at", "n", "bits"])


def page_starts(runs: Iterable[tuple[int, int, np.ndarray]], limit: int, scanned: int) -> list[int]:
    """The ranks that pages begin at, each of which ends at ``limit`` matches or ``scanned`` rows.

    ``runs``: (first rank, rows, places of matches among them), one after the other.
    """
    starts, start, found, end = [0], 0, 0, 0
    for base, n, places in runs:
        hits, i, end = places + base, 0, base + n
        while True:
            full = i + limit - found - 1  # the match that the page ends with
            if full < len(hits) and hits[full] < start + scanned:
                start, i = int(hits[full]) + 1, full + 1
            elif start + scanned <= end:
                start += scanned
                i = int(np.searchsorted(hits, start))
            else:
                found += len(hits) - i
                break
            starts.append(start)
            found = 0
    return [x for x in starts if x < end]


@dataclass(frozen=True)
class Pages:
    """Pages that end at ``limit`` matches (None: at none) or ``scanned`` rows looked at. A range without rows has none."""

    numbered: Numbered
    page: Column
    last: int
    every: bool  # whether all rows are matches
    sorted: bool

    @classmethod
    def cut(cls, of: Numbered, limit: int | None, scanned: int | None, *, every: bool = False, sort: bool = False) -> Pages:
        if limit is None or scanned is None or every or limit >= scanned:
            step = min(x for x in (limit if every else None, scanned) if x is not None)
            return cls(of, F.floor(F.col("_rank") / step).cast("int"), (of.n - 1) // step, every, sort)
        runs = sorted(of.walk.select("_at", "_hit").mapInArrow(_bits, "at bigint, n int, bits binary").collect())
        mask = (1 << BLOCK) - 1
        starts = np.array(page_starts(((of.bases[r.at >> BLOCK] + (r.at & mask), r.n, np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.n))) for r in runs), limit, scanned), np.int64)

        @F.pandas_udf("int")
        def page(ranks: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(starts, ranks.to_numpy(), "right").astype(np.int32) - 1, index=ranks.index)

        return cls(of, page(F.col("_rank")), len(starts) - 1, every, sort)

    def rows(self) -> DataFrame:
        """All rows looked at, with ``_page``."""
        return self.numbered.rows.withColumn("_page", self.page)

    def items(self) -> DataFrame:
        """The matches: page, place (from 0 on over all pages), key and what else they have."""
        hits = self.rows().where("_hit")
        # matches are numbered within their block, after those before it
        place = F.col("_rank") if self.every else F.col("_before") + F.row_number().over(Window.partitionBy("_block").orderBy("_at")) - 1
        return hits.select(F.col("_page").alias("page"), place.alias("place"), *[c for c in hits.columns if not c.startswith("_")])

    def summary(self) -> DataFrame:
        """(page, scanned, items, next_cursor) of each page."""
        rows = self.rows()
        values = [c for c in rows.columns if c[1:].isdigit()]
        last = rows.groupBy("_page").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("_hit").alias("items"), F.max_by(F.struct(*values, "key"), "_rank").alias("last"))
        cursor = F.col("last.key")
        if self.sorted:
            cursor = F.udf(lambda r: encode_cursor(list(r)[:-1], r[-1]), "string")("last")
        return last.select(F.col("_page").alias("page"), "scanned", "items", F.when(F.col("_page") < self.last, cursor).alias("next_cursor"))
