"""lumenspool: DataFrame operators for time-stamped evidence data and training-data corpora."""

__version__ = "0.1.0"
