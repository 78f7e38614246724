"""A PySpark-native, activities-first analytics engine."""

from .functions.primitives import *  # noqa: F403
from .model import *  # noqa: F403
from .operators.quality import CheckResult, CustomSQL, ForeignKey, InRange, InSet, MatchesPattern, MaxAge, NotEmpty, NotNull, QualityCheck, QualityRunner, Unique  # noqa: F401

__version__ = "0.1.0"
