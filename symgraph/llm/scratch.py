"""Tables written between the jobs of an operator; see ``symgraph.tables``."""

from __future__ import annotations

from ..tables import kept as materialize
from ..tables import new_path, release, scope, shared_dir

__all__ = ["materialize", "new_path", "release", "scope", "shared_dir"]
