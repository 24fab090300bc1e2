"""tessera: geospatial, tabular and training-data operators as Spark DataFrame functions."""
