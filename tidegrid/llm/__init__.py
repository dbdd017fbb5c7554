"""Operations of a training-data pipeline, each a Spark job. Nothing else in the library imports this package."""
