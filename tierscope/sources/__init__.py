"""Reading and writing drug-plan tables."""
