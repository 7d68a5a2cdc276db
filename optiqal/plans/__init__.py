"""What is run over the tables: checks, models, views and the catalogue of queries."""
