"""Reading and writing of saved pages, responses and tables."""
