"""covera: insurance-policy preparation, checking and premium modelling on Spark.

Every operator takes and returns Spark DataFrames.  Learnt artefacts
(impute tables, caps, merges, rules, encoder maps, object state) are small
keyed DataFrames; they are joined back with a size-checked broadcast.
"""

__version__ = "0.1.0"
