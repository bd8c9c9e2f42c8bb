"""Long-read overlap graphs as Spark jobs: DataFrames in, DataFrames out."""

from strandweave.params import Params

__all__ = ["Params"]
