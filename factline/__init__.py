"""factline: dated facts (subject, relation, object, timestamp) as Spark DataFrames."""
