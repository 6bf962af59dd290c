"""Operators over text corpora for training-data pipelines. Nothing else in photonlake imports this subpackage."""
