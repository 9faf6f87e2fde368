"""tidemesh: layered interaction graphs, their dynamics and their evidence, as Spark DataFrame plans."""
