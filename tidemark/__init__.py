"""tidemark: exact answers about regular time series, and scoring of submitted answers, on Spark.

Every public function takes and returns DataFrames or Columns and is lazy.  Nothing here collects
data to the driver; the only Python that runs inside tasks is the code policy scan.
"""
