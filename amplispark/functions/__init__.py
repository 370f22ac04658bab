"""amplispark.functions"""
