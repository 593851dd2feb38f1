"""Quality rules: word and line statistics of each text, and lines that many documents of a host share.

A line's words, lower-cased and with every digit as 0, are hashed; per host, the distinct documents
(by their key) that hold each line are counted.  A line in more than both ``least`` documents and
``share`` of the host's documents is boilerplate.  A text that keeps less than ``left`` of its words
without boilerplate is depleted and rejected.

With ``copies=False`` documents of one text count once, so a much copied text is no boilerplate of its
own; that is for a corpus whose copies are to be reduced to one later.

Both joins of many rows deal hot keys over tasks: a line, or a text, that a host repeats very often.

Lines are named by 64 bits of a keyed hash of their words, texts by 128 bits; equal lines inside a text
are compared exactly.

Defined cases: very long texts are read whole; a null text is empty (and so fails the base rule); a null host is a host of its own,
apart from the empty name; lines without a word are not counted; a text with no words is not
depleted; repeated rows each get the same result; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, slices, spread, table, utf8
from .textvec import LOWER, digests, doc_chunks, names, run_hashes, span_codes, span_hashes, sums, tuple_codes, words

LEAST = 10
SHARE = 0.05
LEFT = 0.3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NORMAL = LOWER.copy()
_NORMAL[48:58] = 48

STATS = "key long, host string, text_lo long, text_hi long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, first = words(raw, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    out = {"n_words": np.diff(first), "word_chars": sums(point[ends] - point[starts], first), "n_symbols": sums(_SYMBOLS[raw], offsets)}
    # Lines: cut at newlines and at the edges of texts.
    cuts = np.flatnonzero(raw == 10)
    line_doc = np.concatenate((np.arange(n), np.searchsorted(offsets, cuts, side="right") - 1))
    line_start = np.concatenate((offsets[:-1], cuts + 1))
    order = np.lexsort((line_start, line_doc))
    line_doc, line_start = line_doc[order], line_start[order]
    line_end = np.append(line_start[1:], 0) - 1
    last = np.append(line_doc[1:] != line_doc[:-1], True) if n else np.zeros(0, bool)
    line_end[last] = offsets[1:]
    word_from, word_to = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = word_to > word_from
    line_doc, line_start, line_end, word_from, word_to = (x[full] for x in (line_doc, line_start, line_end, word_from, word_to))
    lines, different = span_codes(raw, line_start, line_end)
    width = len(different[0])
    held = np.unique(line_doc * width + lines) // width
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(held, minlength=n)
    # Words in windows of three that occur twice or more.
    codes, spans = span_codes(raw, starts, ends)
    repeated = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        window = tuple_codes([codes[inside], codes[inside + 1], codes[inside + 2], doc[inside]])
        by = np.argsort(window)
        same = window[by][1:] == window[by][:-1]
        again = np.zeros(len(window), bool)
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        at = inside[again]
        for k in range(3):
            repeated[at + k] = True
    out["n_repeat_words"] = sums(repeated, first)
    # Distinct normalised lines of each text, with all their words.
    normal = names(spans, _NORMAL)[codes]
    line = run_hashes(normal, word_from, word_to)
    by = np.lexsort((line, line_doc))
    line, line_doc, size = line[by], line_doc[by], (word_to - word_from)[by]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (line_doc[1:] != line_doc[:-1])
    heads = np.flatnonzero(new)
    out["lines"] = (line[heads], np.add.reduceat(size, heads) if len(heads) else size, np.bincount(line_doc[heads], minlength=n))
    out["text_lo"], out["text_hi"] = digests(raw, offsets[:-1], offsets[1:])
    return out


def statistics(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Base counts and distinct line hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in doc_chunks(offsets):
                s = _statistics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                line, size, count = s["lines"]
                rows = pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array(size.astype(np.int32))], ["line", "words"])
                lines = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s["text_lo"]), pa.array(s["text_hi"]), *(pa.array(s[k].astype(np.int64)) for k in names), lines],
                    ["key", "host", "text_lo", "text_hi", *names, "lines"],
                )

    return docs.select(F.col(key).cast("long").alias("key"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")).mapInArrow(run, STATS)


def frequent_lines(stats: DataFrame, least: int = LEAST, share: float = SHARE, copies: bool = True) -> DataFrame:
    """(host, line, n_docs) above the limits; documents of one text count once, unless copies."""
    text = F.struct("key") if copies else F.struct("text_lo", "text_hi")
    held = stats.select("host", text.alias("text"), F.explode("lines").alias("x")).select("host", "text", F.col("x.line").alias("line"))
    per_line = held.groupBy("host", "line").agg(F.count_distinct("text").alias("n_docs")).filter(F.col("n_docs") > least)
    per_host = stats.groupBy(F.col("host").alias("h")).agg(F.count_distinct(text).alias("host_docs"))
    return per_line.join(per_host, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n_docs") > share * F.col("host_docs")).select("host", "line", "n_docs")


def verdicts(stats: DataFrame, least: int = LEAST, share: float = SHARE, left: float = LEFT, copies: bool = True) -> DataFrame:
    """stats without lines, with base_failed, removed_words and kept."""
    h = F.coalesce(F.concat(F.lit("+"), "host"), F.lit(""))  # null is a host of its own
    common = cut(frequent_lines(stats, least, share, copies).select(h.alias("h"), "line"))
    held = stats.select(h.alias("h"), "text_lo", "text_hi", F.explode("lines").alias("x")).select("h", "text_lo", "text_hi", "x.line", "x.words")
    # Repeated texts of a host have equal lines, so one row of each is enough.
    removed = spread(held, common, ["h", "line"], "text_lo").distinct().groupBy("h", "text_lo", "text_hi").agg(F.sum("words").alias("removed"))
    out = spread(stats.drop("lines").withColumn("h", h), cut(removed), ["h", "text_lo", "text_hi"], "key", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    return (
        out.withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (rest >= left * F.col("n_words")))
        .drop("h", "removed")
    )


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(statistics(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    out = verdicts(stats)
    return out.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def clean(docs: DataFrame, text: str, host: str, stats: DataFrame, least: int = LEAST, share: float = SHARE, left: float = LEFT, copies: bool = True) -> DataFrame:
    """The rows of docs that are kept, without their boilerplate lines; columns as in docs.

    stats: statistics(docs).  A verdict is the same for equal texts of a host, so rows meet it by host
    and text hashes, one verdict row each; adaptive execution can split a text with very many rows.
    """
    verdict = verdicts(stats, least, share, left, copies).filter("kept").select("host", "text_lo", "text_hi", "removed_words").distinct()
    common = frequent_lines(stats, least, share, copies).select(F.col("host").alias("h"), F.col("line").alias("l"))
    held = stats.select("host", "text_lo", "text_hi", F.explode("lines").alias("x")).select("host", "text_lo", "text_hi", "x.line")
    lines = held.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).groupBy("text_lo", "text_hi", F.col("host").alias("h")).agg(F.collect_set("line").alias("removed"))
    verdict = verdict.alias("v").join(lines.withColumnsRenamed({"text_lo": "lo", "text_hi": "hi"}), (F.col("text_lo") == F.col("lo")) & (F.col("text_hi") == F.col("hi")) & F.col("host").eqNullSafe(F.col("h")), "left")
    columns = docs.columns
    own_lo, own_hi, v_lo, v_hi, v_host, gone = fresh(columns, "lo", "hi", "v_lo", "v_hi", "v_host", "gone")
    verdict = verdict.select(F.col("text_lo").alias(v_lo), F.col("text_hi").alias(v_hi), F.col("host").alias(v_host), F.col("removed").alias(gone))
    at = columns.index(text)
    named = T.StructType([*docs.schema.fields, T.StructField(own_lo, T.LongType()), T.StructField(own_hi, T.LongType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(at))
            lo, hi = digests(raw, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo), pa.array(hi)], [*columns, own_lo, own_hi])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = batch.column(at).to_pylist()
            for d, lines in enumerate(batch.column(len(columns)).to_pylist()):
                if lines:
                    texts[d] = without_lines(texts[d], set(lines))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, columns)

    met = docs.mapInArrow(name, named).join(verdict, (F.col(own_lo) == F.col(v_lo)) & (F.col(own_hi) == F.col(v_hi)) & F.col(host).cast("string").eqNullSafe(F.col(v_host)))
    return met.select(*columns, gone).mapInArrow(strip, docs.schema)


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised hash is in gone; its other lines stay as they are."""
    lines = text.split("\n")
    data = [line.encode() for line in lines]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    raw = np.frombuffer(b"".join(data), np.uint8)
    starts, ends, first = words(raw, offsets)
    hashes = run_hashes(span_hashes(raw, starts, ends, _NORMAL), first[:-1], first[1:]).view(np.int64)
    return "\n".join(line for line, h, n in zip(lines, hashes.tolist(), np.diff(first).tolist()) if not n or h not in gone)
