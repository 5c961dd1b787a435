"""purselight: behavioural feature engineering on transaction histories, on Spark."""
