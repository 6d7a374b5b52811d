"""Text-fidelity and reward analytics on PySpark DataFrames."""
