"""Signed-network balance analytics, expressed as Spark DataFrame plans."""
