"""turnwise: voice-call analytics and training-data preparation as Spark plans."""
