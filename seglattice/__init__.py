"""Dictionary-driven text segmentation and text analytics on Spark DataFrames."""
