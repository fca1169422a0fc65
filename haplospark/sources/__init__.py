"""Graph stores, PLINK files and delimited tables."""
