"""Price and recommendation rules over streams.

Each rule is the batch operator of ``operators.market`` behind a sink that
stores every row: a micro-batch re-derives the contracts it touches (prices from
the last result that stands), so rows may come in any order and no row is too late. The batch operators split a hot
contract by time, which a state per contract could not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import times
from cutline.operators import market as MK
from cutline.operators import timeline as TL
from cutline.streaming.ingest import rederive_batch

BOOK_CLOCK = "observed_at timestamp, observation_id long"
BOOK_SCHEMA = "contract_id long, observation_id long, observed_at timestamp, yes_bid int, yes_ask int, no_bid int, no_ask int"
STATE_SCHEMA = "contract_id long, at timestamp, seq long, is_recommended boolean, side string"
TRANSITION_SCHEMA = "contract_id long, at timestamp, seq long, is_recommended boolean, side string, trigger string"
_DAY = 86_400


def compaction_batch(root: str, heartbeat_minutes: float = K.PRICE_HEARTBEAT_MINUTES, bucket_seconds: int = 7 * _DAY, **storage):
    """Sink keeping the books that changed or are a heartbeat past the last kept one.

    What is kept depends on the last kept book alone, so a contract is worked out
    from there on, and in an orderly stream a micro-batch reads little more than
    itself. An observation that is delivered again comes with its own time.
    """

    def kept(book: DataFrame) -> DataFrame:
        unique = TL.earliest_per_key(book, ["contract_id", "observation_id"], ["observed_at", *MK.SIDES])
        return MK.compact_prices(unique, heartbeat_minutes, bucket_seconds).select(*[c.split()[0] for c in BOOK_SCHEMA.split(", ")])

    return rederive_batch(root, BOOK_SCHEMA, ["contract_id"], kept, clock=[c.split()[0] for c in BOOK_CLOCK.split(", ")], **storage)


def transition_batch(root: str, bucket_seconds: int = 7 * _DAY):
    """Sink writing ``appeared`` and ``state_changed`` rows of slate states.

    It sees only its own writes; snapshots of other triggers belong to the batch operator.
    """

    def written(states: DataFrame) -> DataFrame:
        unique = TL.earliest_per_key(states, ["contract_id", "at", "seq"], ["is_recommended", "side"])
        return MK.transitions(unique, bucket_seconds=bucket_seconds).select(*[c.split()[0] for c in TRANSITION_SCHEMA.split(", ")])

    return rederive_batch(root, STATE_SCHEMA, ["contract_id"], written, TRANSITION_SCHEMA)


def final_capture_batch(root: str, schema: str, kickoff: str = "kickoff_at", at: str = "at", order: tuple[str, ...] = (), minutes: int = K.FINAL_SNAPSHOT_WINDOW_MINUTES):
    """Sink capturing the first state of each contract inside its final window, as a whole row."""
    inside = times.kicks_off_within(F.col(kickoff), F.col(at), minutes=minutes)
    return rederive_batch(root, schema, ["contract_id"], lambda rows: TL.earliest_per_key(rows.where(inside), ["contract_id"], [at, *order]))
