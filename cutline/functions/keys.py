"""Deterministic surrogate keys built from native hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline import constants as K


def uuid5(name: Column, namespace: str = K.KEY_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of ``name``; equals ``uuid.uuid5``."""
    seed = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    h = F.sha1(seed)
    # The variant nibble keeps its low two bits and becomes 8, 9, a or b.
    variant = F.substring(F.lit("89ab" * 4), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"),
        F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def player_key(external: Column) -> Column:
    return uuid5(F.concat(F.lit("nflverse:player:"), external))


def event_key(external: Column) -> Column:
    return uuid5(F.concat(F.lit("nflverse:game:"), external))


def projection_key(entity: Column, event: Column, stat: Column, model: Column, cutoff: Column) -> Column:
    stamp = F.date_format(cutoff, "yyyy-MM-dd'T'HH:mm:ss")
    return uuid5(F.concat_ws(":", F.lit("projection"), entity, event, stat, model, stamp))


def driver_key(projection: Column, rank: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("driver"), projection, rank.cast("string")))


def prediction_id(event: Column, entity: Column, stat: Column, model: Column, cutoff: Column) -> Column:
    """Identity of one prediction. The cutoff is part of it: a moved cutoff is
    a different prediction."""
    stamp = F.date_format(cutoff, "yyyy-MM-dd'T'HH:mm:ss")
    parts = F.concat_ws("\x1e", event.cast("string"), entity.cast("string"), stat, model, stamp)
    return F.substring(F.sha2(parts, 256), 1, 32)
