"""Text entity detection and anonymisation as Spark DataFrame operators."""
