"""Lattica: graph analytics and table operators expressed as Spark DataFrame plans."""
