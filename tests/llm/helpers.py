"""Plain versions of the rules that the operators' tests share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=True):
    return WORD.findall((text or "").translate(ASCII_LOWER) if lower else text or "")


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def documents(spark, rows, extra=False):
    """A documents table of (doc_id, text) rows; extra: with columns whose names clash with the operators' own."""
    if extra:
        return spark.createDataFrame([(*r, 1, "x", 2, 3.0) for r in rows], "doc_id long, text string, n int, node string, shard int, size double")
    return spark.createDataFrame(rows, "doc_id long, text string")
