"""IQ-waveform and sensor analytics expressed as Spark DataFrame jobs."""
