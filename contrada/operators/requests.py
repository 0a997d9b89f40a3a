"""Validation of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

CITY_LIMIT, ZONE_LIMIT, QUESTION_LIMIT = 100, 200, 500


def rejected(citta, zona, domanda, city_limit: int = CITY_LIMIT, zone_limit: int = ZONE_LIMIT, question_limit: int = QUESTION_LIMIT) -> Column:
    """Why a request is rejected: the first of a blank city, a blank zone, a length over its limit; null where it is accepted."""
    return (
        F.when(~text.filled(citta), "citta vuota").when(~text.filled(zona), "zona vuota")
        .when(F.length(citta) > city_limit, "citta troppo lunga").when(F.length(zona) > zone_limit, "zona troppo lunga").when(F.length(domanda) > question_limit, "domanda troppo lunga")
    )
