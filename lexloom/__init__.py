"""Text-to-obligation analytics on Spark."""
