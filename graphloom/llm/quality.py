"""Quality rules by repetition coverage.

For each whole text, rolling hashes over its words find the n-grams of several lengths that occur again. A repeat's
words, first occurrences not counted, are covered once however many n-grams hold them; their characters over all word
characters are the coverage of that length. Lines equal to an earlier line are measured likewise. A text is rejected if
a coverage passes its length's limit.

Words are maximal runs of other characters than space and \\t to \\r. Cases: null and empty texts have no words and fail
the base rule; repeated rows are judged alike, one by one; a long text is one slice of its own, whole. Work is linear in
the text but for one sort of its word windows; longer n-grams are looked up only where their first three words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, mix, powers, slices, small_batches, span_hashes, trimmed, word_spans

#: Most coverage by n, and of repeated lines: twice the usually published figures, which a short clean text passes that
#: repeats a single line.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = True
_INVERSE = pow(int(BASE), -1, 1 << 64)
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_coverage double, ngram_coverage array<double>"


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of flags from each offset to the next."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[off[1:]] - sums[off[:-1]]


def repeats(key: np.ndarray, first_too: bool) -> np.ndarray:
    """Which entries occur again; without first_too, only those with an equal one before them."""
    order = np.argsort(key, kind=None if first_too else "stable")
    again = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][again]] = True
    if first_too:
        out[order[:-1][again]] = True
    return out


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in the windows of n words that begin at the places at."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The fields of each row of a slice."""
    rows = len(off) - 1
    starts, ends, row = word_spans(buf, off)
    n = len(starts)
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = lead[ends] - lead[starts]
    first = np.searchsorted(row, np.arange(rows + 1))
    tag = row.astype(np.uint64) << U64(54)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(span_hashes(buf, starts, ends) * powers("up", int(BASE), n), out=sums[1:])
    back = powers("down", _INVERSE, n + 1)

    def windows(at: np.ndarray, k: int) -> np.ndarray:
        """Row and rolling hash of the k words from each place."""
        return tag[at] | (mix((sums[at + k] - sums[at]) * back[at]) >> U64(10))

    at = np.arange(max(0, n - 2))
    at = at[row[at] == row[at + 2]] if len(at) else at
    again = at[repeats(windows(at, 3), True)] if len(at) else at
    total = np.maximum(per_row(chars, first), 1)
    coverage = np.zeros((rows, len(NGRAM_LIMITS)))
    for x, k in enumerate(NGRAM_LIMITS):
        own = again[again + k <= n]
        own = own[row[own] == row[own + k - 1]]
        if len(own):
            coverage[:, x] = per_row(chars * covered(own[repeats(windows(own, k), False)], k, n), first) / total

    newline = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate((off[:-1], newline + 1)))
    line_row = np.searchsorted(off, line_start, side="right") - 1
    # an empty row's start and a final newline's next place belong to the row before
    line_end = np.minimum(np.concatenate((line_start[1:], [len(buf)])), np.append(off, len(buf))[np.minimum(line_row + 1, rows)])
    line_end = np.where((line_end > line_start) & (buf[np.maximum(line_end - 1, 0)] == 10 if len(buf) else False), line_end - 1, line_end)
    held = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    real = held > 0
    line_start, line_end, line_row = line_start[real], line_end[real], line_row[real]
    same = repeats((line_row.astype(np.uint64) << U64(54)) | (span_hashes(buf, line_start, line_end) >> U64(10)), False) if len(line_row) else np.zeros(0, bool)
    in_words = np.concatenate(([0], np.cumsum(chars)))
    line_chars = in_words[np.searchsorted(starts, line_end)] - in_words[np.searchsorted(starts, line_start)]
    return {
        "n_words": np.diff(first), "word_chars": per_row(chars, first), "n_symbols": per_row(_SYMBOL[buf], off),
        "n_dup_lines": np.bincount(line_row[same], minlength=rows), "n_repeat_words": per_row(covered(again, 3, n), first),
        "line_coverage": np.bincount(line_row[same], weights=line_chars[same], minlength=rows) / total, "ngram_coverage": coverage,
    }


def _measured(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in slices(batch.column("text")):
                m = measure(buf, off)
                values = [*batch.slice(i, j - i).select(carried).columns]
                values += [pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                values += [pa.array(m["line_coverage"]), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(NGRAM_LIMITS)), pa.array(m["ngram_coverage"].ravel()))]
                yield pa.RecordBatch.from_arrays(values, names=[*carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_coverage", "ngram_coverage"])
    return run


def verdicts(df: DataFrame) -> DataFrame:
    """Adds base_failed and kept to measured rows."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    much = F.col("line_coverage") > LINE_LIMIT
    for x, limit in enumerate(NGRAM_LIMITS.values()):
        much = much | (F.col("ngram_coverage")[x] > limit)
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~much)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the measured fields, base_failed and kept of each row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return verdicts(rows.mapInArrow(trimmed(_measured(["doc_id"])), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    small_batches(docs.sparkSession)
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index('text')}").cast("string"))
    carried = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} {t}" for c, t in renamed.dtypes if c in carried)
    out = verdicts(renamed.mapInArrow(trimmed(_measured(carried)), f"{schema}, {FIELDS}"))
    return out.where("kept").select(carried).toDF(*names)


def oracle() -> str:
    """The same rows in DuckDB."""
    grams, columns, tests = [], [], []
    for k in NGRAM_LIMITS:
        gram = " || chr(10) || ".join(["w"] + [f"lead(w, {d}) OVER p" for d in range(1, k)])
        grams.append(f"""g{k} AS (SELECT rid, pos, CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY rid, g ORDER BY pos) > 1 THEN 1 ELSE 0 END AS hit
    FROM (SELECT rid, pos, {gram} AS g FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos))),
c{k} AS (SELECT rid, sum(CASE WHEN inside = 1 THEN n ELSE 0 END) AS s FROM (SELECT w.rid, length(w.w) AS n,
    max(hit) OVER (PARTITION BY w.rid ORDER BY w.pos ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS inside FROM w JOIN g{k} USING (rid, pos)) GROUP BY rid)""")
        columns.append(f"LEFT JOIN c{k} USING (rid)")
        tests.append(f"coalesce(c{k}.s, 0) / greatest(word_chars, 1)::DOUBLE > {NGRAM_LIMITS[k]}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
three AS (SELECT rid, pos, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS hit
    FROM (SELECT rid, pos, w || chr(10) || lead(w, 1) OVER p || chr(10) || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos))),
words AS (SELECT rid, count(*) AS n_words, sum(n) AS word_chars, sum(inside) AS n_repeat_words FROM (SELECT w.rid, length(w.w) AS n,
    max(hit) OVER (PARTITION BY w.rid ORDER BY w.pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM w JOIN three USING (rid, pos)) GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d)),
lines AS (SELECT rid, count(*) AS n_dup_lines, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS line_chars
    FROM (SELECT *, row_number() OVER (PARTITION BY rid, l ORDER BY pos) AS k FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')) WHERE k > 1 GROUP BY rid),
{', '.join(grams)},
m AS (SELECT rid, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0) / greatest(coalesce(word_chars, 0), 1)::DOUBLE AS line_coverage
    FROM d LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT much AS kept FROM (
    SELECT m.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words AS base_failed,
    line_coverage > {LINE_LIMIT} OR {' OR '.join(tests)} AS much FROM m {' '.join(columns)})"""
