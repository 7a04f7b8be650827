"""loomgraph: a Spark-native knowledge-graph analytics engine.

Functions that run on executors are pickled by value, so workers need no copy
of this package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

from .config import Config  # noqa: E402
from .engine import Engine, Knowledge  # noqa: E402
from .logs import setup_logger  # noqa: E402
from .operators.extract import CallableExtractor, ReplayExtractor, RuleExtractor  # noqa: E402
from .operators.kg import KnowledgeGraph  # noqa: E402
from .operators.ontology import Ontology  # noqa: E402
from .operators.similarity import CallableEncoder, HashedNgrams  # noqa: E402
from .operators.verify import Policies  # noqa: E402
from .plans.prompts import LanguageModel, PromptTemplate  # noqa: E402
from .sources.rdf import read, write  # noqa: E402

__all__ = [
    "CallableEncoder", "CallableExtractor", "Config", "Engine", "HashedNgrams", "Knowledge", "KnowledgeGraph", "LanguageModel", "Ontology", "Policies",
    "PromptTemplate", "ReplayExtractor", "RuleExtractor", "read", "setup_logger", "write",
]
