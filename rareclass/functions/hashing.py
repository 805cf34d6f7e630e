"""Portable hash order, hash uniforms and content fingerprints.

Everything here is md5/sha2 over text, so any SQL engine reproduces the same draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_32_BITS = 4294967296.0


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_text(seed: int | str | Column, *parts: str | Column) -> Column:
    """md5 of ``seed:part:part...``; the seed may itself be a column."""
    head = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head, *[as_col(p).cast("string") for p in parts]))


def hash_uniform(seed: int | str | Column, *parts: str | Column) -> Column:
    """A uniform in [0, 1) from the first eight hex digits of :func:`hash_text`."""
    digits = F.substring(hash_text(seed, *parts), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(HEX_32_BITS)


def row_digest(columns: Sequence[str]) -> Column:
    """md5 of a row's values in the given order.

    Every cell is written as its length, a colon and its text, NULL as ``-``: no two rows are written alike.
    """
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
             for c in columns]
    return F.md5(F.concat(*cells))


def _lane(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def dataset_fingerprint(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), out: str = "data_hash"
) -> DataFrame:
    """H1: order-free content hash of a table (or of each ``keys`` group).

    Each row is hashed on its own; four 32-bit lanes are summed, so partial sums combine
    map-side and no group is ever gathered. Schema text and row count are part of the hash.
    """
    types = dict(df.dtypes)
    schema_text = ",".join(f"{c} {types[c]}" for c in columns)
    digest = row_digest(columns)
    lanes = [F.sum(_lane(digest, 1 + 8 * i).cast("decimal(38,0)")).alias(f"_lane{i}") for i in range(4)]
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *lanes)
    # the schema comes first with its length, so a column name cannot run into the counts
    text = F.concat_ws(
        "|",
        F.lit(f"{len(schema_text)}:{schema_text}"),
        F.col("n_rows").cast("string"),
        *[F.coalesce(F.col(f"_lane{i}"), F.lit(0)).cast("string") for i in range(4)],
    )
    return sums.select(*keys, "n_rows", F.sha2(text, 256).alias(out))


def partition_fingerprint(
    assignment: DataFrame, id_col: str = "row_id", client_col: str = "client_id",
    keys: Sequence[str] = (),
) -> DataFrame:
    """H2: one hash of a client assignment, clients taken in order.

    Per client only a fixed-size digest is kept; the final text has one entry per client.
    """
    per_client = dataset_fingerprint(
        assignment.select(*keys, client_col, F.col(id_col).cast("bigint").alias(id_col)),
        [id_col], [*keys, client_col], out="_client_hash",
    )
    entry = F.struct(F.col(client_col).alias("c"), F.col("_client_hash").alias("h"))
    return per_client.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sha2(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(entry)),
                    lambda e: F.concat_ws(":", F.length(e["c"].cast("string")).cast("string"), e["c"].cast("string"), e["h"]),
                ),
                "|",
            ),
            256,
        ).alias("partition_hash"),
    )
