"""Analytics on per-frame motion data and training-data pipelines, as Spark DataFrame operators."""
