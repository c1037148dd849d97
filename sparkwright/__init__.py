"""Set-oriented site and answer diagnosis on Spark."""
