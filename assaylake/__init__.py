"""assaylake: evaluation analytics for question-answering systems on Spark DataFrames."""
