"""Tamper-evident audit logs on Spark: sealing, reading, verifying and querying HMAC chains as DataFrames."""
