"""beatloom: drum-event analytics over catalogues of tracks, as PySpark DataFrames."""
