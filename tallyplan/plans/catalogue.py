"""All registered queries and their SQL."""

from tallyplan.plans import conflicts, evaluation, lists, lookups, preferred, ranking, raster, reports, resolve, review, rules, selection, spatial, store, streams, takeoff, text, tiled, traces, validation, values, windows  # noqa: F401  they register
from tallyplan.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
