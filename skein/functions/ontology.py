"""The graph's vocabulary of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types, relationship types, and other names for them.
ENTITY_TYPES = "PERSON ORGANIZATION TECHNOLOGY MODEL ALGORITHM DATASET CONCEPT METHOD METRIC EVENT REGULATION POLICY PRODUCT LOCATION DATE".split()
RELATIONSHIP_TYPES = "USES HAS_COMPONENT PART_OF DEVELOPED_BY CREATED_BY PROPOSED_BY IMPLEMENTED_BY EVALUATED_ON ACHIEVES IMPROVES COMPARES_WITH RELATED_TO LOCATED_IN OCCURRED_ON PASSED SIGNED GOVERNED_BY APPLIES_TO SUPPORTS".split()
ENTITY_ALIASES = {
    "DATASET": "REPORT PAPER STUDY SURVEY DOCUMENT PUBLICATION ARTICLE BENCHMARK", "ORGANIZATION": "PROJECT PROGRAM COMPANY INSTITUTION ORGANISATION AGENCY CORP",
    "TECHNOLOGY": "SYSTEM FRAMEWORK HARDWARE SOFTWARE LIBRARY ARCHITECTURE", "PRODUCT": "TOOL", "REGULATION": "STANDARD LAW LEGISLATION ACT BILL DIRECTIVE", "POLICY": "INITIATIVE",
    "PERSON": "INDIVIDUAL RESEARCHER AUTHOR", "CONCEPT": "TASK POSITION ROLE HAS_COMPONENT", "METRIC": "METRIC_SCORE SCORE",
}
RELATIONSHIP_ALIASES = {
    "USES": "USED_BY COMPUTES", "RELATED_TO": "DESCRIBED_BY ASSOCIATED_WITH", "IMPROVES": "REPLACES", "EVALUATED_ON": "EVALUATED_BY TESTED_ON BENCHMARKED_ON", "DEVELOPED_BY": "BUILT_BY MADE_BY PRODUCED_BY",
    "CREATED_BY": "FOUNDED_BY INVENTED_BY AUTHORED_BY AUTHORED PUBLISHED_BY", "PART_OF": "CONTAINED_IN SUBSET_OF", "HAS_COMPONENT": "CONTAINS", "COMPARES_WITH": "SIMILAR_TO",
}


def _resolve(c: Column, types: list[str], aliases: dict[str, str]) -> Column:
    t = F.upper(F.trim(c))
    names = {a: k for k, v in aliases.items() for a in v.split()}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    t = F.coalesce(F.try_element_at(lookup, t), t)
    return F.when(t.isin(types), t)


def entity_type(c: Column) -> Column:
    """The type by its own or another name; null if there is no such type."""
    return _resolve(c, ENTITY_TYPES, ENTITY_ALIASES)


def relationship_type(c: Column) -> Column:
    return _resolve(c, RELATIONSHIP_TYPES, RELATIONSHIP_ALIASES)
