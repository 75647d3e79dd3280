"""All registered queries; importing a module registers its queries."""

from scriptorium.plans import (  # noqa: F401
    answers, contexts, dialogue, documents, examples, expanded, operations, questions, retrieval, streams,
)
from scriptorium.plans.registry import ORACLES, QUERIES  # noqa: F401
