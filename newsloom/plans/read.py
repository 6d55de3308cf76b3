"""The read path: status of each asked job and, once done, the cards of its ticker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from newsloom.constants import FRAGMENTS_SHOWN, NO_EVENTS
from newsloom.functions.status import status_class
from newsloom.operators.current import newest_per_key
from newsloom.operators.jobs import latest_status
from newsloom.operators.lookups import only
from newsloom.operators.reports import cards
from newsloom.operators.spread import spread_join
from newsloom.session import materialise


def job_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct (job_id, ticker) with ``status`` and its class ``state``."""
    known = latest_status(only(events, jobs, ["job_id"]))
    asked = jobs.select("job_id", "ticker").distinct()
    status = F.coalesce(F.col("status"), F.lit(NO_EVENTS))
    return asked.join(known, "job_id", "left").withColumns(
        {"status": status, "state": status_class(status)}
    )


def job_cards(
    jobs: DataFrame, events: DataFrame, fragments: DataFrame, n: int = FRAGMENTS_SHOWN,
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """The newest ``n`` cards of the ticker of every job that is done."""
    states = job_states(jobs, events)
    done = keep(states.filter(F.col("state") == "done").select("job_id", "ticker"))
    newest = newest_per_key(only(fragments, done, ["ticker"]), "ticker", "time_created", n)
    return spread_join(done, cards(newest), ["ticker"], "inner")
