"""All registered queries and their oracle SQL (the llm package registers its own)."""

from inkstone.functions import counts, deletions, signals, text, tiles  # noqa: F401  registers relations
from inkstone.operators import components, custom, dedup, discourse, distance, evaluate, families, hygiene, judged, keyness, lexical, prose, relational, resampling, sequence  # noqa: F401
from inkstone.plans import catalogue
from inkstone.streaming import events

QUERIES = catalogue.queries() | components.QUERIES | custom.QUERIES | prose.QUERIES | events.QUERIES
ORACLES = catalogue.oracles() | components.oracles() | events.ORACLES
