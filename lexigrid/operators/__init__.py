"""Sequence sets, segmenters and the tagger."""

from .segment import LongestMatch, LongestMatchModel, LongestStringMatching, RandomSegmenter, RandomSegmenterTransformer
from .sequences import SequenceSet
from .tagging import AveragedPerceptronTagger, PerceptronTagger, PerceptronTaggerModel

__all__ = ["AveragedPerceptronTagger", "LongestMatch", "LongestMatchModel", "LongestStringMatching", "PerceptronTagger", "PerceptronTaggerModel", "RandomSegmenter", "RandomSegmenterTransformer", "SequenceSet"]
