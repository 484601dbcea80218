"""Line dedup: hash ranges sorted by document and position, keep bitmaps as result. DataFrame operations only.

Lines are split at ``\\n``; a line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased.

Counting: every line becomes (96-bit key hash, row, position). Hashes are uniform, so their top bits cut them into
equal ranges; a range is dealt out together with a salt of the row, hence a line that a third of all rows hold is
spread over ``SALTS`` tasks. Each task sorts by hash, then document, then position and streams through it: a row that
differs from the one before it is a new document, the first row of a hash is its first occurrence. Slices are then
added up per hash with map-side combining.

Marking: the lines whose key is in ``min_docs`` documents or more are joined back by hash, and their positions become
one run-length coded keep bitmap per distinct text: ``keep_runs``, an array of (first, length). The ``HOT`` most frequent
keys are spread over ``SALTS`` tasks there. No text is shuffled for the bitmaps. ``line_dedup`` and ``without_lines``
then join texts to bitmaps by fingerprint, which shuffles every text once, and slice the kept lines out of them.

Defined cases: a null text is one empty line, as the empty text is; each row is a document, also where ids repeat or
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, checkpointed

SALTS = 64
HOT = 1000
RANGE_BITS = 12
FINGERPRINT = ["fp64", "fp32"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def fingerprint(text: Column) -> list[Column]:
    """96 bits that stand for a text; equal texts have equal bitmaps."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("fp64"), F.crc32(t.cast("binary")).alias("fp32")]


def _keyed(lines: DataFrame, min_chars: int) -> DataFrame:
    return lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= max(min_chars, 1)).select(
        *[c for c in lines.columns if c != "line"], F.xxhash64("key").alias("k64"), F.hash("key").alias("k32"))


def repeated_keys(docs: DataFrame, min_docs: int, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k64, k32, n_docs, first_doc, first_fp64, first_fp32, first_pos) of each key in ``min_docs`` documents or more."""
    rows = docs.select(F.col(id_col).alias("doc"), *fingerprint(F.col(text_col)), F.monotonically_increasing_id().alias("rid"), lines_of(F.col(text_col)).alias("lines"))
    lines = _keyed(rows.select("doc", *FINGERPRINT, "rid", F.posexplode("lines").alias("pos", "line")), min_chars)
    ranged = lines.select("*", F.shiftrightunsigned("k64", 64 - RANGE_BITS).alias("range"), F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt")).repartition("range", "salt")
    stream = Window.partitionBy("range", "salt", "k64", "k32").orderBy("doc", "rid", "pos")
    firsts = ranged.withColumn("before", F.lag("rid").over(stream)).where(F.col("before").isNull() | (F.col("before") != F.col("rid")))
    at = F.struct("doc", "fp64", "fp32", "pos")
    return (firsts.groupBy("k64", "k32").agg(F.count(F.lit(1)).alias("n_docs"), F.min(at).alias("at"))
            .where(F.col("n_docs") >= min_docs)
            .select("k64", "k32", "n_docs", F.col("at.doc").alias("first_doc"), F.col("at.fp64").alias("first_fp64"), F.col("at.fp32").alias("first_fp32"), F.col("at.pos").alias("first_pos")))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """Run-length code of a keep bitmap from the sorted dropped positions: array of (first, length)."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), ends), F.concat(starts, F.array(n_lines)), lambda e, s: F.struct((e + 1).alias("first"), (s - e - 1).alias("length")))
    return F.filter(gaps, lambda g: g["length"] > 0)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct text that loses a line: (fp64, fp32, n_lines, n_dropped, keep_runs).

    ``keep="none"`` drops every line whose key is in ``min_docs`` documents; ``keep="first"`` leaves the first
    occurrence by document id, then fingerprint, then position.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    keys = checkpointed(repeated_keys(docs, min_docs, min_chars, id_col, text_col))
    hot = F.broadcast(keys.orderBy(F.col("n_docs").desc(), "k64", "k32").limit(HOT).select("k64", "k32", F.lit(True).alias("hot")))  # HOT rows
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    keys = keys.join(hot, ["k64", "k32"], "left").withColumn("salt", F.explode(salts)).drop("hot", "n_docs")
    rows = docs.select(F.col(id_col).alias("doc"), *fingerprint(F.col(text_col)), lines_of(F.col(text_col)).alias("lines"))
    lines = _keyed(rows.select("doc", *FINGERPRINT, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")), min_chars)
    lines = lines.join(hot, ["k64", "k32"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("fp64", "fp32", "doc"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    hit = lines.join(keys, ["k64", "k32", "salt"])
    if keep == "first":
        hit = hit.where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("fp64") == F.col("first_fp64")) & (F.col("fp32") == F.col("first_fp32")) & (F.col("pos") == F.col("first_pos"))))
        # copies of one text under other ids lose the line that the first document keeps
        hit = hit.withColumn("doc_key", F.xxhash64(F.coalesce(F.col("doc").cast("string"), F.lit("-"))))
        by = [*FINGERPRINT, "doc_key"]
    else:
        by = FINGERPRINT
    return hit.groupBy(*by).agg(F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("dropped")).select(
        *by, "n_lines", F.size("dropped").alias("n_dropped"), keep_runs(F.col("n_lines"), F.col("dropped")).alias("keep_runs"))


def apply_runs(text: Column, runs: Column) -> Column:
    """The text that a bitmap keeps; a null bitmap keeps all."""
    lines = lines_of(text)
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["first"] + 1, r["length"]))), "\n"))


def _joined(docs: DataFrame, min_docs: int, min_chars: int, keep: str, id_col: str, text_col: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with their bitmaps' columns under names that nothing else has; and (n_lines, n_dropped, keep_runs, kept_text)."""
    maps = keep_bitmaps(docs, min_docs, min_chars, keep, id_col, text_col).drop("n_lines").withColumnsRenamed({"fp64": "_line_m64", "fp32": "_line_m32", "doc_key": "_line_mkey", "n_dropped": "_line_dropped", "keep_runs": "_line_runs"})
    f64, f32 = fingerprint(F.col(text_col))
    own = docs.withColumns({"_line_f64": f64, "_line_f32": f32})
    on = (F.col("_line_f64") == F.col("_line_m64")) & (F.col("_line_f32") == F.col("_line_m32"))
    if keep == "first":
        on = on & (F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("-"))) == F.col("_line_mkey"))
    made = [F.size(lines_of(F.col(text_col))).cast("long"), F.coalesce(F.col("_line_dropped"), F.lit(0)).cast("long"), F.col("_line_runs"), apply_runs(F.col(text_col), F.col("_line_runs"))]
    return own.join(maps, on, "left"), made


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep_runs (null: all lines stay) and kept_text; columns of these names are replaced."""
    joined, made = _joined(docs, min_docs, min_chars, keep, id_col, text_col)
    names = ["n_lines", "n_dropped", "keep_runs", "kept_text"]
    return joined.select(*[F.col(c) for c in docs.columns if c not in names], *[m.alias(n) for m, n in zip(made, names, strict=True)])


def without_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text in place of the text, all other columns as they are."""
    joined, made = _joined(docs, min_docs, min_chars, keep, id_col, text_col)
    return joined.select(*[made[3].alias(c) if c == text_col else F.col(c) for c in docs.columns])
