"""Barcode analytics on Spark: matching, correction, annotation and counting of tagged sequencing reads as DataFrames."""
