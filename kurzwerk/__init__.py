"""kurzwerk: preparing, condensing and scoring document corpora with Spark DataFrames."""

from kurzwerk.params import Params

__all__ = ["Params"]
