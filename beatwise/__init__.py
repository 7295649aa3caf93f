"""Field-sales territory and journey-plan analytics as Spark DataFrame operators."""
