"""Decision-tree analytics on large tables with PySpark.

``timberline.sources`` read and write, ``timberline.functions`` build Columns,
``timberline.operators`` map DataFrames to DataFrames, ``timberline.plans`` hold
the tree model and recipes, ``timberline.streaming`` scores streams.
"""
