"""amplispark.streaming"""
