"""tabloom: the tabular machine-learning workflow as Spark DataFrame operators."""
