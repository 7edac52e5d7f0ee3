"""Dashboard-ready data from tables of any size, as Spark plans."""
