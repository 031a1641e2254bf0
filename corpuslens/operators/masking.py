"""Training targets for masked and causal language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORE_LABEL, MASK_ID, MASK_PROBABILITY
from ..functions.hashing import hex_slice
from .tokens import is_special

_RANGE = 1 << 32
_UNPICKED = "g" * 16  # comes after all hex digits


def _hex8(x: float) -> str:
    """A bound as eight hex digits; one above all of them comes after every digit."""
    return f"{int(x):08x}" if x < _RANGE else "g"


def mlm_mask(
    df: DataFrame,
    chunk_key: Column,
    vocab_size: int,
    seed: int,
    epoch: int = 0,
    ids: str = "input_ids",
    probability: float = MASK_PROBABILITY,
) -> DataFrame:
    """Add ``masked_ids`` and ``labels``.

    About ``probability`` of the ordinary tokens are picked; of these 80 % become the
    mask, 10 % a random token and 10 % stay. Labels hold the picked tokens and are
    ignored elsewhere. Picks follow from (seed, epoch, chunk, position) alone, so a
    retried task masks the same tokens.
    """
    # Hex digits of one length compare as the numbers do, so only a random token needs a number.
    picked_below, masked_below, kept_from = (_hex8(x * _RANGE) for x in (probability, 0.8, 0.9))

    def draws(prefix: Column) -> Column:
        def draw(x: Column, i: Column) -> Column:
            key = F.md5(F.concat(prefix, i.cast("string")).cast("binary"))
            return F.when(is_special(x), F.lit(_UNPICKED)).otherwise(key)

        return F.transform(F.col(ids), draw)

    # The chunk's own part of the draw is put together once, not for every token.
    prefix = F.concat(F.lit(f"{seed}:{epoch}:"), chunk_key.cast("string"), F.lit(":"))
    keys = F.element_at(F.transform(F.array(prefix), draws), 1)
    drawn = F.arrays_zip(F.col(ids).alias("id"), F.col("_keys").alias("key"))

    def is_picked(t: Column) -> Column:
        return F.substring(t["key"], 1, 8) < picked_below

    def masked_token(t: Column) -> Column:
        half = F.substring(t["key"], 9, 8)
        return (
            F.when(~is_picked(t) | (half >= kept_from), t["id"])
            .when(half < masked_below, F.lit(MASK_ID))
            .otherwise((hex_slice(t["key"], 1) % vocab_size).cast("int"))
        )

    return (
        df.withColumn("_keys", keys)
        .withColumn("_drawn", drawn)
        .withColumn("masked_ids", F.transform("_drawn", masked_token))
        .withColumn("labels", F.transform("_drawn", lambda t: F.when(is_picked(t), t["id"]).otherwise(IGNORE_LABEL)))
        .drop("_keys", "_drawn")
    )


def clm_labels(ids: Column, pad_id: int) -> Column:
    """The tokens themselves, with padding ignored. A model without its own padding
    token passes its end token."""
    return F.transform(ids, lambda x: F.when(x == pad_id, IGNORE_LABEL).otherwise(x))
