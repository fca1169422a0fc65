"""A PySpark-native engine for genotype graphs and the statistics on top of them."""
