"""corpusloom subpackage."""
