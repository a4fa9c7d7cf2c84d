"""All queries of the corpus operators, and their SQL."""

from layerflow.llm import collocations, decontamination, extraction, fingerprints, jaccard, language, licences, mixing, neighbours, privacy, quality, sharding, spelling  # noqa: F401
from layerflow.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
