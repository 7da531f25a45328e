"""corpusloom: composable Spark DataFrame operators for multilingual text corpora."""
