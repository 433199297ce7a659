"""driftline: sensor-log and training-data analytics on PySpark."""
