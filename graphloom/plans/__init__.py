"""Logical plans: graphs, the fixpoint driver and the graphs derived from relational tables."""

from .adjacency import Adjacency
from .fixpoint import Fixpoint, remove, scratch, scratch_path
from .graph import Graph
from .layers import Layers

__all__ = ["Adjacency", "Fixpoint", "Graph", "Layers", "remove", "scratch", "scratch_path"]
