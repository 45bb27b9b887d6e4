"""prosa: conversation analytics expressed as Spark DataFrame transformations."""

from prosa.params import CANONICAL, NOTEBOOK, Profile
from prosa.session import build_session

__all__ = ["CANONICAL", "NOTEBOOK", "Profile", "build_session"]
