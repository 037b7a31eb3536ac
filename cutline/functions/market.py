"""Edge arithmetic: one place for side selection and confidence weighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline import constants as K
from cutline.functions import numbers as N


def edge(probability: Column, confidence: Column, yes_ask: Column, no_ask: Column,
         threshold: float = K.RECOMMENDATION_THRESHOLD_POINTS) -> dict[str, Column]:
    """Side, edge and recommendation against the executable ask of the better side.

    A missing probability, confidence or ask propagates as NULL, never as zero.
    """
    priced = probability.isNotNull() & confidence.isNotNull()
    yes = F.when(priced, probability * 100 - yes_ask)
    no = F.when(priced, (F.lit(1.0) - probability) * 100 - no_ask)
    side = F.when(yes.isNotNull() & (no.isNull() | (yes >= no)), "yes").when(no.isNotNull(), "no")
    best = F.greatest(yes, no)
    adjusted = N.half_up_2(best * F.element_at(N.literal_map(K.CONFIDENCE_WEIGHTS), confidence))
    return {
        "side": side,
        "edge_points": N.half_up_2(best),
        "adjusted_edge": adjusted,
        "is_recommended": F.coalesce(adjusted >= threshold, F.lit(False)),
        "ask_cents": F.when(side == "yes", yes_ask).when(side == "no", no_ask),
    }


def staleness(kickoff: Column, cutoff: Column, latest_fact: Column, now: Column,
              lead_minutes: int = K.INACTIVES_LEAD_MINUTES) -> dict[str, Column]:
    """Both staleness states; NULL where there is no projection to qualify."""
    boundary = kickoff - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lead_minutes))
    shown = cutoff.isNotNull()
    late = now >= boundary
    return {
        "is_stale": F.when(shown, F.coalesce(latest_fact > cutoff, F.lit(False))),
        "predates_inactives": F.when(shown, late),
        "inactives_expected_at": F.when(shown & late, boundary),
    }


def signal_state(expected: Column, attempt: Column, attempt_started: Column, last_success: Column,
                 late_after_minutes: Column, now: Column, timeout_minutes: int = K.RUN_TIMEOUT_MINUTES) -> Column:
    """not_expected, then running/failed, then never_run, then late/ok."""
    minutes = lambda since: (F.unix_millis(now) - F.unix_millis(since)) / 60000.0
    overdue = minutes(attempt_started) > timeout_minutes
    return (
        F.when(~expected, "not_expected")
        .when((attempt == "running") & overdue, "failed")
        .when(attempt == "running", "running")
        .when(attempt.isin("failed", "incomplete"), "failed")
        .when(last_success.isNull(), "never_run")
        .when(minutes(last_success) > late_after_minutes, "late")
        .otherwise("ok")
    )
