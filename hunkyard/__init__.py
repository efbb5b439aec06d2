"""hunkyard: Spark operators over code changes, reviews and the texts around them."""
