"""Spark-native invoice audit: duplicate payments, overpayments and unusual invoices as DataFrame plans."""
