"""Lake inventory analytics on PySpark.

Listings of files go in as DataFrames; categories, duplicate groups, move
plans, the operation log and its reversal come out as DataFrames.
"""
