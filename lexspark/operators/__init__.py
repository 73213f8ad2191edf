"""Jobs over whole tables: each takes DataFrames and returns DataFrames."""
