"""riskmart: credit-risk feature building, evaluation and scoring as Spark DataFrame plans.

Sub-packages
------------
functions  null-safe Column helpers (ratios, flags, clips, row statistics)
sources    table readers/writers, schemas, the adapter views used by tests and queries
operators  feature packs, validation, preprocessing, splits, metrics, models, attribution, scoring
plans      multi-step compositions (master table, evaluation, distributed running totals, query catalog)
streaming  Structured Streaming scoring job
"""

__version__ = "0.1.0"
