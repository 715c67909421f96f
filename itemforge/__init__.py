"""Frequent-itemset analytics and data preparation on PySpark."""
