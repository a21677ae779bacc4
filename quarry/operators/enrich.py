"""Batch enrichment (C10) and the built-in hash embedder.

The reference calls a model once per changed file from its own goroutine.  Here
a user function runs over Arrow batches with ``mapInPandas``: rows are spread
over partitions (the partition count is the rate limit), per-row failures land
in an ``error`` column instead of failing the job, and ok/error rows are split
afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.guards import spread

# Fixed values of the hash embedder (must match the oracle): tokens are maximal
# runs of [a-z0-9] in the lower-cased text; bucket = first 4 hex digits of the
# token's md5, mod the dimension.
TOKEN_SPLIT = "[^a-z0-9]+"
HASH_HEX_DIGITS = 4


def tokens(text) -> F.Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda w: w != "")


def token_bucket(word: F.Column, dim: int) -> F.Column:
    return F.conv(F.substring(F.md5(word), 1, HASH_HEX_DIGITS), 16, 10).cast("int") % dim


def hash_embed(df: DataFrame, *, id_col: str, text_col: str = "text", dim: int = 64) -> DataFrame:
    """Deterministic bag-of-hashed-tokens embedding, L2-normalised.

    The texts are dealt out by id once; tokens are exploded, counted per (row,
    bucket) and assembled to the ``dim`` counts per row on that partitioning, without
    another shuffle.  Output:
    ``id, counts array<bigint>, embedding array<float>`` (null embedding for a
    text without tokens; the reference treats empty input as an error)."""
    src = spread(df.select(id_col, text_col), id_col)
    # explode_outer keeps rows without tokens (w = null) so no join back is needed
    words = src.select(F.col(id_col), F.explode_outer(tokens(text_col)).alias("w"))
    per_bucket = words.select(id_col, token_bucket(F.col("w"), dim).alias("b")).groupBy(id_col, "b").count()
    entries = F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "count")))
    counts = per_bucket.groupBy(id_col).agg(F.map_from_entries(entries).alias("m"))
    counts = counts.select(id_col, F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))
    ).alias("counts"))
    sumsq = F.aggregate("counts", F.lit(0.0).cast("double"), lambda s, c: s + (c * c).cast("double"))
    emb = F.when(sumsq > 0, F.transform("counts", lambda c: (c / F.sqrt(sumsq)).cast("float")))
    return counts.withColumn("embedding", emb)


def enrich_batch(
    df: DataFrame,
    fn: Callable[[str], object],
    *,
    input_col: str,
    output_col: str,
    output_type: T.DataType = T.StringType(),
    partitions: int | None = None,
) -> DataFrame:
    """Apply ``fn`` (text -> value, one call per row inside Arrow batches) to
    ``input_col``; failures are reported per row in ``error`` (C10).
    Empty results count as skipped (``output_col`` null, ``error`` null).  Rows are dealt
    over ``partitions`` tasks (the rate limit; default: the session's shuffle partitions)."""
    out_schema = T.StructType(df.schema.fields + [T.StructField(output_col, output_type, True),
                                                   T.StructField("error", T.StringType(), True)])

    def run(batches):
        for pdf in batches:
            vals, errs = [], []
            for x in pdf[input_col]:
                try:
                    v = fn(x)
                    vals.append(None if v is None or v == "" else v)
                    errs.append(None)
                except Exception as e:  # noqa: BLE001 - reported per row
                    vals.append(None)
                    errs.append(f"{type(e).__name__}: {e}")
            pdf = pdf.copy()
            pdf[output_col] = vals
            pdf["error"] = errs
            yield pdf

    return spread(df, partitions=partitions).mapInPandas(run, out_schema)


def split_errors(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok rows, error rows) of an ``enrich_batch`` result."""
    return enriched.filter(F.col("error").isNull()), enriched.filter(F.col("error").isNotNull())
