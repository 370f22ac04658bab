"""amplispark.plans"""
