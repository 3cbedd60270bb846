"""planspark: drawing-quantity analytics as Spark DataFrame operators."""
