"""tierscope: drug-plan analytics as lazy PySpark DataFrame operators."""
