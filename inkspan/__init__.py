"""OCR benchmark analytics expressed as Spark DataFrame jobs."""
