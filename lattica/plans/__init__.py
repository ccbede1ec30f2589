"""Logical building blocks: the graph model and loops over DataFrames."""
