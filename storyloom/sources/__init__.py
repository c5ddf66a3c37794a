"""Reading and writing the tables of the narrative model."""
