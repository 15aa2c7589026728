"""Kerbside: address-level field-work planning expressed as Spark DataFrame plans."""
