"""Knowledge-memory jobs on Spark: ingestion, hybrid retrieval, exploration, recall, maintenance and evaluation.

Every public function takes DataFrames and returns DataFrames, so one job serves many queries, scopes or patients.
"""
