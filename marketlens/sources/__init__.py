"""Reading the retail tables and writing results."""
