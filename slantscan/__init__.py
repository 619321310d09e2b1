"""slantscan: comment-bias analytics on Spark.

Main entry points::

    from slantscan import analyze, score_v1, score_v2
    from slantscan.operators import prep, sample, aggregate, lexicon, evaluate, model
"""

from .plans.analyze import analyze, score_v1, score_v2

__all__ = ["analyze", "score_v1", "score_v2"]
