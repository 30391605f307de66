"""Quality rules whose cutoffs come from the corpus: mergeable quantile sketches per language and source.

Each row's whole text gives a few counts. Ratios of them go into log-bucket sketches (relative error
``ACCURACY``), which are plain (cell, feature, bucket, count) rows: they merge by adding counts, so the
aggregation is partial on the map side whatever the size of a source. Only texts that pass the base rule
are in them, as the others are refused anyway. Cutoffs per cell are Tukey fences from the sketch's
quartiles. Quantiles of a cell are drawn towards its language's, and those towards the corpus's, as if ``PRIOR_ROWS`` more rows had
these; so a cell that grows changes its cutoffs bit by bit. Most texts
repeat nothing, so the fences of repeats are those of the texts that do. Where the quartiles coincide (texts without any
symbols), the cutoff is the quantile ``TAIL``. A join with the cutoffs then filters: a text is refused for what lies beyond
its cutoff by more than ``FENCE`` standard errors of a ratio over so short a text, one more occurrence counted in. No distance is fixed.

Defined cases: null text counts as empty; null language or source is a cell of its own; empty texts fail
the base rule (fewer than 50 words); repeated rows get equal verdicts; empty tables give empty results;
other columns are carried, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import free_name, text_of, written

ACCURACY = 0.01
#: how many rows the wider sketch counts for in a cell's quantiles
PRIOR_ROWS = 50
FENCE, TAIL = 3.0, 0.9
FEATURES = ("symbol_ratio", "punct_ratio", "upper_ratio", "word_length", "dup_line_ratio", "repeat_ratio")
#: features for which too low a value is refused as well
TWO_SIDED = {"word_length"}
#: features that are 0 for most texts: their quartiles are those of the other values
SPARSE = {"dup_line_ratio", "repeat_ratio"}
#: what each feature is a ratio to
SIZES = {"symbol_ratio": "n_words", "punct_ratio": "n_chars", "upper_ratio": "n_chars", "word_length": "n_words", "dup_line_ratio": "n_lines", "repeat_ratio": "n_words"}
#: cutoffs are broadcast up to this many cells, and joined by a shuffle beyond
BROADCAST_CELLS = 20_000

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_chars"]
_TYPE = T.StructType([T.StructField(c, T.LongType(), False) for c in _COUNTS])
_BLANK = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of _COUNTS for one text; words are runs without the six ASCII blanks."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 2:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) < len(grams):
            count = Counter(grams)
            twice = np.fromiter((count[g] > 1 for g in grams), bool, len(grams))
            cover = np.zeros(n, bool)
            cover[:-2] |= twice
            cover[1:-1] |= twice
            cover[2:] |= twice
            repeated = int(cover.sum())
    size = len(raw)
    less = lambda chars: size - len(raw.translate(None, chars))
    return n, len(text) - less(_BLANK), less(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), less(_UPPER), less(_PUNCT), len(text)


def annotate(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "counts") -> DataFrame:
    """The columns ``keep`` (all, if None) and a struct column ``out`` with the counts of each row's text."""
    keep = docs.columns if keep is None else keep
    at = [i for i, c in enumerate(docs.columns) if c in keep]

    def run(batches):
        for b in batches:
            rows = list(zip(*map(text_counts, text_of(b.column(b.num_columns - 1))))) or [()] * len(_COUNTS)
            struct = pa.StructArray.from_arrays([pa.array(r, pa.int64()) for r in rows], _COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), struct], names=[*names, out])

    fields = [docs.schema[i] for i in at]
    names = [f.name for f in fields]
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(free_name(docs, "whole_text"))).mapInArrow(run, T.StructType([*fields, T.StructField(out, _TYPE, False)]))


def _size(c: str, feature: str) -> Column:
    return F.greatest(F.col(f"{c}.{SIZES[feature]}").cast("double"), F.lit(1.0))


def _ratios(c: str) -> dict[str, Column]:
    of = {"symbol_ratio": "n_symbols", "punct_ratio": "n_punct", "upper_ratio": "n_upper", "word_length": "word_chars", "dup_line_ratio": "n_dup_lines", "repeat_ratio": "n_repeat_words"}
    return {f: F.col(f"{c}.{x}").cast("double") / _size(c, f) for f, x in of.items()}


def _base_failed(c: str) -> Column:
    n, repeated = F.col(f"{c}.n_words"), F.col(f"{c}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def sketch(rows: DataFrame, counts: str = "counts") -> DataFrame:
    """Rows (lang, source, feature, bucket, n) of a mergeable sketch of the texts that pass the base rule."""
    log_gamma = math.log((1 + ACCURACY) / (1 - ACCURACY))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in _ratios(counts).items()])).alias("f")
    bucket = F.when(F.col("f.value") > 0, F.ceil(F.log(F.col("f.value")) / log_gamma).cast("int"))
    return rows.where(~_base_failed(counts)).select("lang", "source", values).select("lang", "source", F.col("f.feature").alias("feature"), bucket.alias("bucket")).groupBy("lang", "source", "feature", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(merged: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """Quantiles of each sketch of ``by``: a null bucket is the value 0 and comes first. A sketch has few buckets, so its window is small."""
    w = Window.partitionBy(*by)
    running = F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    rows = merged.select(*by, value.alias("value"), running.alias("upto"), F.sum("n").over(w).alias("total"))
    return rows.groupBy(*by).agg(F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("value"))).alias(k) for k, q in qs.items()])


def cutoffs(sketches: DataFrame) -> DataFrame:
    """One row for each (lang, source): lo and hi for each feature, null where nothing is refused."""
    qs = {"q1": 0.25, "q3": 0.75, "tail": TAIL}
    # a cell in which no text has the feature still has a row of it, with nothing counted
    cells = sketches.select("lang", "source").distinct().withColumn("feature", F.explode(F.array(*[F.lit(f) for f in FEATURES])))
    sketches = sketches.where(~F.col("feature").isin(*SPARSE) | F.col("bucket").isNotNull())
    cell = quantiles(sketches, ["lang", "source", "feature"], qs)
    lang = quantiles(sketches.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n")), ["lang", "feature"], qs)
    every = quantiles(sketches.groupBy("feature", "bucket").agg(F.sum("n").alias("n")), ["feature"], qs)
    pick = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    same = lambda p, *by: [F.col(c).eqNullSafe(F.col(f"{p}_{c}")) for c in by]
    j = cells.join(pick(cell, "c"), same("c", "lang", "source", "feature"), "left").join(pick(lang, "l"), same("l", "lang", "feature"), "left").join(pick(every, "e"), same("e", "feature"), "left")

    def drawn(p, q, towards):
        n = F.coalesce(F.col(f"{p}_total"), F.lit(0))
        return (n * F.coalesce(F.col(f"{p}_{q}"), F.lit(0.0)) + PRIOR_ROWS * towards) / (n + PRIOR_ROWS)

    level = lambda q: drawn("c", q, drawn("l", q, F.col(f"e_{q}")))
    spread = level("q3") - level("q1")
    hi = F.when(spread > 0, level("q3") + FENCE * spread).otherwise(level("tail"))
    lo = F.when(F.col("feature").isin(*TWO_SIDED), F.greatest(level("q1") - FENCE * spread, F.lit(0.0)))
    rows = j.select("lang", "source", "feature", hi.alias("hi"), lo.alias("lo"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("feature") == f, F.col(x))).alias(f"{f}_{x}") for f in FEATURES for x in ("lo", "hi")])


def judge(rows: DataFrame, cuts: DataFrame, counts: str = "counts", prefix: str = "") -> DataFrame:
    """Add base_failed, failed (names of the features beyond their cutoffs) and kept, each behind ``prefix``, to rows with counts, lang and source."""
    cuts = written(cuts)
    names = {c: free_name(rows, f"cut_{c}") for c in cuts.columns}
    cuts = cuts.select(*[F.col(c).alias(n) for c, n in names.items()])
    if cuts.count() <= BROADCAST_CELLS:
        cuts = F.broadcast(cuts)
    j = rows.join(cuts, F.col("lang").eqNullSafe(F.col(names["lang"])) & F.col("source").eqNullSafe(F.col(names["source"])), "left")
    hi, lo = ({f: F.col(names[f"{f}_{x}"]) for f in FEATURES} for x in ("hi", "lo"))
    error = lambda cut, f: FENCE * F.sqrt((cut + 1 / _size(counts, f)) / _size(counts, f))
    beyond = [F.when((v > hi[f] + error(hi[f], f)) | (v < lo[f] - error(lo[f], f)), F.lit(f)) for f, v in _ratios(counts).items()]
    failed = F.array_compact(F.array(*beyond))
    base = _base_failed(counts)
    return j.select(*[rows[c] for c in rows.columns], base.alias(f"{prefix}base_failed"), failed.alias(f"{prefix}failed"), (~base & (F.size(failed) == 0)).alias(f"{prefix}kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, counts, base_failed, failed, kept. The counts are written once; both the sketches and the filter read them."""
    rows = written(annotate(docs.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"]))
    return judge(rows, cutoffs(sketch(rows)))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep.

    Texts are read twice, once for the sketches and once to filter, rather than written with their counts.
    """
    slim = annotate(docs.select("lang", "source", "text"), keep=["lang", "source"])
    counts = free_name(docs, "quality_counts")
    rows = annotate(docs, out=counts)
    cuts = cutoffs(sketch(slim))
    return judge(rows, cuts, counts, f"{counts}_").where(F.col(f"{counts}_kept")).select(*docs.columns)


_STATED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_counts(spark, sf_dir: str) -> DataFrame:
    """The counts and the base rule alone, which SQL can say too."""
    rows = annotate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in _STATED], _base_failed("counts").alias("base_failed"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    v = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return v.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in _STATED], "base_failed", "kept")
