"""amplispark.operators"""
