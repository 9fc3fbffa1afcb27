"""quizlens: evaluate answers about pictures with Spark DataFrames."""
