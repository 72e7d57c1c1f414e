"""weirflow: program analysis as Spark relations."""
