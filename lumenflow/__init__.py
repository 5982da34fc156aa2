"""lumenflow: machine-vision dataflows and training-data operations as Spark plans."""
