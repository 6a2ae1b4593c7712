"""Operations of a training-data pipeline, written on Spark.  Nothing outside this folder imports it."""
